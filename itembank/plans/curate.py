"""The reference flows as compositions of operators: papers to reviewed questions, request to paper."""
from __future__ import annotations

from pyspark.sql import DataFrame

from itembank.operators import documents as dc
from itembank.operators import link as lk
from itembank.operators import report as rp
from itembank.operators import review as rv
from itembank.operators import select as sel


def reviewed_questions(items: DataFrame, docs: DataFrame, segments: DataFrame, printed: DataFrame | None = None) -> DataFrame:
    """Extracted items to flagged questions: answers only from answer pages, linked, audited, flagged."""
    trusted = dc.sanitize(items, docs, segments)
    linked = lk.match_solutions(trusted.filter("kind = 'question'"), trusted.filter("kind = 'solution'"))
    if printed is not None:
        linked = lk.audit_answers(linked, printed)
    return rv.item_flags(linked)


def selection_paper(bank: DataFrame, groups: list[dict], exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(paper lines, selection report) of a grouped request; groups stay together on the paper."""
    selected, report = sel.quota_select(bank, groups, exclude)
    # At most 15,000 rows by the checked request, so the paper order fits one integer.
    ordered = selected.withColumn("ord", selected["sel_group"] * 1000 + selected["sel_rank"])
    return rp.paper_rows(ordered, order="ord"), report
