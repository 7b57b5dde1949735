"""Joining questions to solutions, pages, figures and numbering."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itembank.functions import text as tx
from itembank.functions.predicates import flag_list
from itembank.operators import gaps as gp
from itembank.operators.skew import attach_per_key

# Flags that results depend on.
FLAG_DUPLICATE_NUMBER = "题号重复"
FLAG_AMBIGUOUS = "答案关联不唯一"
FLAG_INCOMPLETE_SOLUTION = "答案解析不完整"
FLAG_AUDIT_DIFFERS = "答案复核不一致"
FLAG_AUDIT_MISSING = "答案未通过独立复核"


def int_number(number) -> Column:
    """A question number as an integer, null if it is not digits once full-width forms are folded."""
    n = tx.normalize_number(number)
    return F.when(n.rlike(r"\A[0-9]+\z"), n.try_cast("bigint"))


def match_solutions(questions: DataFrame, solutions: DataFrame) -> DataFrame:
    """Assign each question the one solution that can only be meant for it.

    Exact key is (group, section, number). Without an exact hit, (group, number) counts if the
    question number is unique in the group and so is the solution. Several hits, or a repeated
    question key, assign nothing and set a flag. Keys are aggregated first, so each join meets one
    row per key; the solution's content is fetched last, by its unique id.
    """
    exact, loose = ["grp", "section", "number"], ["grp", "number"]
    blank = {c: "" for c in exact}
    # Numbers as they are printed (full width, with a full stop) meet as what they mean.
    questions, solutions = (d.fillna(blank).withColumn("number", tx.normalize_number("number")) for d in (questions, solutions))
    numbered = solutions.filter(F.coalesce(F.col("number"), F.lit("")) != "")
    s_exact = numbered.groupBy(*exact).agg(F.count(F.lit(1)).alias("n_exact"), F.min("pos").alias("s_exact"))
    s_loose = s_exact.groupBy(*loose).agg(F.sum("n_exact").alias("n_loose"), F.min("s_exact").alias("s_loose"))
    q_exact = questions.groupBy(*exact).agg(F.count(F.lit(1)).alias("key_count"))
    q_loose = q_exact.groupBy(*loose).agg(F.sum("key_count").alias("num_count"))
    # Everything a question needs to know about its key, one row per (group, section, number).
    stats = (
        q_exact.join(q_loose, loose)
        .join(s_exact, exact, "left")
        .join(s_loose, loose, "left")
        .select(*exact, "key_count", "num_count", "n_exact", "s_exact", "n_loose", "s_loose")
    )
    rows = attach_per_key(questions, stats, exact, "key_count")
    has_number = F.coalesce(F.col("number"), F.lit("")) != ""
    n_exact = F.coalesce(F.col("n_exact"), F.lit(0))
    fallback = has_number & (n_exact == 0) & (F.col("num_count") == 1) & (F.col("n_loose") == 1)
    n_hits = F.when(~has_number, 0).when(n_exact > 0, n_exact).when(fallback, 1).otherwise(0)
    assigned = (F.col("n_hits") == 1) & (F.col("key_count") == 1)
    picked = rows.withColumn("n_hits", n_hits).withColumn(
        "solution_pos", F.when(assigned, F.when(n_exact > 0, F.col("s_exact")).otherwise(F.col("s_loose")))
    ).withColumn("match_method", F.when(assigned & fallback, "unique_number_in_linked_paper").when(assigned, "exact"))
    content = solutions.select(
        F.col("pos").alias("solution_pos"), tx.normalize_answer("answer").alias("s_answer"),
        F.coalesce(F.col("explanation"), F.lit("")).alias("s_explanation"), F.col("source_file").alias("s_file"),
        F.col("source_pages").alias("s_pages"), F.coalesce(F.col("complete"), F.lit(False)).alias("s_complete"),
    )
    hit = F.col("solution_pos").isNotNull()
    own = F.coalesce(F.col("answer"), F.lit(""))
    old = tx.normalize_answer("answer")
    # Questions without a solution meet none: they are spread by their own position, on ids that no solution has.
    apart = F.coalesce(F.col("solution_pos"), -1 - F.col("pos"))
    joined = picked.withColumn("__to", apart).join(content.withColumnRenamed("solution_pos", "__to"), "__to", "left").drop("__to")
    return joined.select(
        *[c for c in questions.columns if c not in ("answer", "explanation")],
        F.when(hit, F.col("s_answer")).otherwise(own).alias("answer"),
        F.when(hit, F.col("s_explanation")).otherwise(F.col("explanation")).alias("explanation"),
        "solution_pos", "match_method", "key_count",
        F.when(hit, F.struct(F.col("s_file").alias("source_file"), F.col("s_pages").alias("source_pages"))).alias("answer_source"),
        F.when(hit & (own != "") & (old != F.col("s_answer")), own).alias("replaced_answer"),
        flag_list(
            (F.col("key_count") > 1, FLAG_DUPLICATE_NUMBER),
            (hit & ~F.col("s_complete"), FLAG_INCOMPLETE_SOLUTION),
            (~hit & (F.col("n_hits") >= 1), FLAG_AMBIGUOUS),
        ).alias("link_flags"),
    )


def _numbered_docs(docs: DataFrame, roles: list[str], kind: Column) -> DataFrame:
    """Continuously numbered documents of the roles: ``source_file``, ``kind``, ``last``, ``pages``."""
    last = F.col("last_question_number")
    chosen = docs.filter(F.col("continuous_numbering") & (last >= 1) & F.col("role").isin(*roles))
    return chosen.select(F.col("id").alias("source_file"), kind.alias("kind"), last.cast("long").alias("last"), "pages")


def _numbered_rows(items: DataFrame) -> DataFrame:
    return items.withColumn("n", int_number("number")).filter("n IS NOT NULL").select(
        "source_file", "kind", "n", "pos", F.array_min("source_pages").alias("lo"), F.array_max("source_pages").alias("hi"))


def coverage(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Missing and repeated numbers of continuously numbered question documents, as intervals ``n`` to ``to_n``.

    A run of missing numbers is one row, whatever its length; a repeated number is one, even beyond the last expected one.
    """
    chosen = _numbered_docs(docs, ["questions", "mixed"], F.lit("question"))
    present = gp.number_rows(_numbered_rows(items.filter("kind = 'question'")))
    missing = gp.gaps(present, chosen).select("source_file", F.col("from_n").alias("n"), "to_n", F.lit("missing").alias("problem"))
    repeated = present.filter("cnt > 1").join(chosen.select("source_file"), "source_file", "left_semi")
    return missing.union(repeated.select("source_file", "n", F.col("n").alias("to_n"), F.lit("duplicate")))


def _spans(targets: DataFrame, lo: Column, hi: Column, max_targets: int | None, max_pages: int | None) -> DataFrame:
    """``first_page``, ``last_page`` and ``status`` of intervals, whose paper has ``targets`` numbers to read again."""
    spans = targets.withColumns({"first_page": F.greatest(F.lit(1), lo), "last_page": F.least(F.col("pages"), hi)})
    spans = spans.withColumns({c: F.when(lo.isNotNull() & hi.isNotNull(), F.col(c)) for c in ("first_page", "last_page")})
    length = F.col("last_page") - F.col("first_page") + 1
    status = F.when(length.isNull(), "no_rows").when(length < 1, "no_pages")
    if max_targets is not None:
        status = status.when(F.col("targets") > max_targets, "too_many_targets")
    if max_pages is not None:
        status = status.when(length > max_pages, "too_many_pages")
    return spans.withColumn("status", status.otherwise("ready"))


def coverage_worklist(items: DataFrame, docs: DataFrame, max_targets: int | None = None, max_pages: int | None = None) -> DataFrame:
    """Page spans to read again for numbers that do not occur exactly once, as intervals ``n`` to ``to_n``.

    A repeated number spans its own rows. Missing ones span from their lower to their upper neighbour, or cover the two
    nearest rows when one side is empty, so a run of them has one span. Every target returns: ``status`` is ``ready``, ``no_rows`` if the paper has
    nothing to go by, ``no_pages`` if the span lies beyond the document, or, with limits given, ``too_many_targets`` (the
    paper's) or ``too_many_pages``.
    """
    chosen = _numbered_docs(docs, ["questions", "solutions"], F.when(F.col("role") == "questions", "question").otherwise("solution"))
    present = gp.number_rows(_numbered_rows(items))
    near = F.when(F.size("below") * F.size("above") == 0, gp.nearest_two(F.col("from_n")))
    left, right = F.get("below", F.lit(0))["one"]["hi"], F.get("above", F.lit(0))["one"]["lo"]
    missing = gp.gaps(present, chosen).withColumn("near", near).select(
        *gp.KEY, "from_n", "to_n", "pages",
        F.when(F.col("near").isNull(), F.least(left, right)).otherwise(F.array_min("near.lo")).alias("lo"),
        F.when(F.col("near").isNull(), F.greatest(left, right)).otherwise(F.array_max("near.hi")).alias("hi"))
    repeated = present.filter("cnt > 1").join(chosen, gp.KEY).filter("n <= last AND n >= 1").select(*gp.KEY, "n", F.col("n").alias("to_n"), "pages", "lo", "hi")
    targets = missing.union(repeated)
    totals = targets.groupBy(*gp.KEY).agg(F.sum(F.col("to_n") - F.col("from_n") + 1).alias("targets"))
    # A row per gap, but a paper may have most of them.
    counted = attach_per_key(targets, totals, gp.KEY, row_id="from_n")
    return _spans(counted, F.col("lo"), F.col("hi"), max_targets, max_pages).select(
        *gp.KEY, F.col("from_n").alias("n"), "to_n", "first_page", "last_page", "status")


def missing_worklist(
    items: DataFrame, docs: DataFrame, raw: DataFrame | None = None, max_missing: int | None = None, max_pages: int | None = None,
) -> DataFrame:
    """Second variant: only missing question numbers, each with the pages of its two nearest rows and one page on each side, as
    intervals ``n`` to ``to_n`` of one span, with a ``status`` as in ``coverage_worklist``.

    ``raw`` rows (source_file, number, source_pages), for example items another batch owned, are looked at before the two
    nearest rows.
    """
    chosen = _numbered_docs(docs, ["questions", "solutions", "mixed", "unknown"], F.lit("question"))
    present = gp.number_rows(_numbered_rows(items.filter("kind = 'question'")))
    seen = None
    if raw is not None:
        seen = raw.withColumn("n", int_number("number")).filter("n IS NOT NULL").groupBy("source_file", "n").agg(
            F.min(F.array_min("source_pages")).alias("seen_lo"), F.max(F.array_max("source_pages")).alias("seen_hi")
        ).withColumn("kind", F.lit("question"))
    found = gp.gaps(present, chosen, seen)
    totals = found.groupBy("source_file").agg(F.sum(F.col("to_n") - F.col("from_n") + 1).alias("targets"))
    counted = attach_per_key(gp.by_nearest(found).withColumn("near", gp.nearest_two(F.col("from_n"))), totals, ["source_file"], row_id="from_n")
    lo, hi = F.coalesce("seen_lo", F.array_min("near.lo")) - 1, F.coalesce("seen_hi", F.array_max("near.hi")) + 1
    return _spans(counted, lo, hi, max_missing, max_pages).select("source_file", F.col("from_n").alias("n"), "to_n", "first_page", "last_page", "status")


def overlap_candidates(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of every numbered key where two rows share a page.

    No pairs are built: a page that holds two rows of the key is found by counting (key, page),
    and the marked keys are attached to their rows.
    """
    keys = keys or ["source_hash", "kind", "section", "number"]
    numbered = items.filter(F.coalesce(F.col("number"), F.lit("")) != "")
    pages = numbered.select(*keys, "pos", F.explode(F.array_distinct("source_pages")).alias("page"))
    shared = pages.groupBy(*keys, "page").agg(F.count(F.lit(1)).alias("on_page"))
    sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_in_key"))
    stats = shared.filter("on_page > 1").select(*keys).distinct().join(sizes, keys)
    return attach_per_key(numbered, stats, keys, how="inner")


def apply_reconciliation(items: DataFrame, verdicts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Replace a candidate set by its merged record.

    ``verdicts`` hold the key, ``same_question`` and ``merged`` (array of item structs with ``pos``).
    Only a set judged the same, with exactly one record of unchanged kind and number, is replaced.
    """
    keys = keys or ["source_hash", "kind", "section", "number"]
    one = F.col("merged")[0]
    good = verdicts.filter(
        F.col("same_question") & (F.size("merged") == 1) & (F.try_element_at("merged", F.lit(1))["kind"] == F.col("kind"))
        & (F.try_element_at("merged", F.lit(1))["number"] == F.col("number"))
    )
    fields = [f.name for f in verdicts.schema["merged"].dataType.elementType.fields]
    # A merged key is replaced as a whole; keys without overlapping candidates keep their rows.
    overlapping = overlap_candidates(items, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    good = good.join(overlapping, keys)
    kept = attach_per_key(items, good.select(*keys), keys, how="anti").withColumn("reconciled", F.lit(False))
    merged = good.select(*[one[c].alias(c) if c in fields else F.col(c) for c in items.columns if c in fields or c in keys])
    return kept.unionByName(merged.withColumn("reconciled", F.lit(True)), allowMissingColumns=True)


def audit_answers(questions: DataFrame, printed: DataFrame) -> DataFrame:
    """Compare linked answers with independently printed ones.

    ``printed`` holds (source_file, page, number, answer). Readings of the question's number on the
    answer's pages count; without any, the single other page of the file that prints the number is
    added. Distinct readings are kept as a count and extremes, enough to tell whether the set is
    exactly the answer.
    """
    reads = printed.select(
        F.col("source_file").alias("a_file"), F.col("page").alias("a_page"),
        tx.normalize_number("number").alias("a_number"), tx.normalize_answer("answer").alias("reading"),
    ).groupBy("a_file", "a_number", "a_page").agg(F.min("reading").alias("r_min"), F.max("reading").alias("r_max"))
    located = reads.groupBy("a_file", "a_number").agg(
        F.count(F.lit(1)).alias("n_pages"), F.min("a_page").alias("only_page"),
        F.min("r_min").alias("l_min"), F.max("r_max").alias("l_max"),
    )
    number = tx.normalize_number("number")
    asked = questions.filter(
        F.col("answer_source").isNotNull() & (F.coalesce(F.col("answer"), F.lit("")) != "")
    ).select("pos", F.col("answer").alias("__answer"), F.col("answer_source.source_file").alias("a_file"),
             number.alias("a_number"), F.col("answer_source.source_pages").alias("__pages"))
    on_page = asked.select("pos", "a_file", "a_number", F.explode(F.array_distinct("__pages")).alias("a_page"))
    # Linking gives a solution to one question at most, so no (file, number) collects many of them.
    by_page = on_page.join(reads, ["a_file", "a_number", "a_page"]).groupBy("pos").agg(F.min("r_min").alias("p_min"), F.max("r_max").alias("p_max"))
    rows = asked.join(by_page, "pos", "left").join(located, ["a_file", "a_number"], "left")
    moved = F.col("p_min").isNull() & (F.col("n_pages") == 1)
    lo = F.coalesce(F.col("p_min"), F.when(moved, F.col("l_min")))
    hi = F.coalesce(F.col("p_max"), F.when(moved, F.col("l_max")))
    matches = F.coalesce((lo == hi) & (lo == F.col("__answer")), F.lit(False))
    verdict = rows.select(
        "pos", F.when(moved, F.col("only_page")).alias("recovered_page"), matches.alias("audit_matches"),
        F.when(matches, F.lit(None)).when(lo.isNotNull(), FLAG_AUDIT_DIFFERS).otherwise(FLAG_AUDIT_MISSING).alias("audit_flag"),
    )
    return questions.join(verdict, "pos", "left")


def share_figures(questions: DataFrame) -> DataFrame:
    """Spread reviewed shared figures to the questions they name.

    Input has ``figures: array<struct<page, bbox, shared_with, sharing_reviewed, shared_from>>``.
    A figure shared without review marks its owner instead; figures received by sharing stay put.
    """
    f = "f"
    own = questions.select("pos", "source_hash", "section", F.col("number").alias("owner"), F.explode("figures").alias(f))
    fresh = own.filter(F.coalesce(F.col("f.shared_from"), F.lit("")) == "")
    reviewed = F.coalesce(F.col("f.sharing_reviewed"), F.lit(False))
    blocked = fresh.filter((F.size("f.shared_with") > 0) & ~reviewed).select("pos").distinct()
    offers = fresh.filter(reviewed).select(
        F.col("pos").alias("owner_pos"), "source_hash", "section", "owner", f, F.explode(F.array_distinct("f.shared_with")).alias("number")
    )
    targets = questions.select("pos", "source_hash", "section", "number", F.col("figures").alias("__have"))
    given = F.col(f).withField("shared_from", F.col("owner").cast("string"))
    # A figure the question has already, as its own or from an earlier sharing, is not added again.
    held = F.array_contains("__have", F.col(f)) | F.array_contains("__have", given)
    received = targets.join(offers, ["source_hash", "section", "number"]).filter(
        (F.col("pos") != F.col("owner_pos")) & ~F.coalesce(held, F.lit(False))
    )
    mark = received.withColumn("got", F.struct(F.col("owner_pos").alias("o"), given.alias("f")))
    # Offers per question come from the figures of its own section; each owner offers a figure once.
    got = mark.groupBy("pos").agg(F.array_sort(F.collect_set("got")).alias("__got"))
    out = questions.join(got, "pos", "left").join(blocked.withColumn("sharing_unreviewed", F.lit(True)), "pos", "left")
    return out.select(
        *[c for c in questions.columns if c != "figures"],
        F.concat(
            F.coalesce(F.col("figures"), F.array().cast(questions.schema["figures"].dataType)),
            F.coalesce(F.transform("__got", lambda g: g["f"]), F.array().cast(questions.schema["figures"].dataType)),
        ).alias("figures"),
        F.coalesce(F.col("sharing_unreviewed"), F.lit(False)).alias("sharing_unreviewed"),
    )


def recovery_sources(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """Files of each group in which a missing answer may be looked up.

    Answer and mixed documents if the group has any; otherwise the documents and question sources
    not known to be question-only.
    """
    d = docs.select("grp", F.col("id").alias("file"), "role")
    formal = d.filter(F.col("role").isin("solutions", "mixed")).select("grp", "file")
    groups = questions.select("grp").distinct()
    without = groups.join(formal.select("grp").distinct(), "grp", "left_anti")
    blocked = d.filter("role = 'questions'").select("grp", "file")
    listed = d.select("grp", "file").unionByName(questions.select("grp", F.col("source_file").alias("file")))
    loose = listed.filter("file <> ''").distinct().join(without, "grp", "left_semi").join(blocked, ["grp", "file"], "left_anti")
    return formal.join(groups, "grp", "left_semi").distinct().unionByName(loose)


def replace_rows(base: DataFrame, fixed: DataFrame) -> DataFrame:
    """Recovered rows replace every earlier row of the same (file, kind, number)."""
    key = ["source_file", "kind", "__n"]
    norm = tx.normalize_number("number")
    fixed_keys = fixed.select("source_file", "kind", norm.alias("__n")).distinct()
    kept = attach_per_key(base.withColumn("__n", norm), fixed_keys, key, how="anti").drop("__n")
    return kept.unionByName(fixed, allowMissingColumns=True)
