"""Row predicates of the review and ingest gates, as boolean columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itembank.functions.text import as_col, strip

# Cues and flags that results depend on.
FIGURE_CUE = "如图|下图|图中|图示|图表|见图|右图|左图"
MEDIA_FLAGS = ["题图待视觉复核", "题图提取待复核"]
CONFLICT_FLAGS = ["答案冲突", "答案复核不一致"]
NO_ANSWER_FLAG = "原文未提供答案"


def missing(answer) -> Column:
    return strip(F.coalesce(as_col(answer).cast("string"), F.lit(""))) == ""


def discarded(status) -> Column:
    return F.coalesce(as_col(status) == "discarded", F.lit(False))


def suspected_figure(stem, *figure_fields) -> Column:
    """A figure field is filled, or the stem mentions a figure. Fields are booleans or arrays of any type."""
    found = F.coalesce(as_col(stem), F.lit("")).rlike(FIGURE_CUE)
    for field in figure_fields:
        found = found | F.coalesce(field, F.lit(False))
    return found


def filled(array) -> Column:
    """True for a non-empty array."""
    return F.coalesce(F.size(as_col(array)) > 0, F.lit(False))


def pending(status, answer, flags, suspected, figure_status) -> Column:
    unconfirmed = F.coalesce(as_col(figure_status), F.lit("")) != "confirmed"
    return ~discarded(status) & ~missing(answer) & (filled(flags) | (suspected & unconfirmed))


def has_flag(flags, words: list[str]) -> Column:
    """Some flag contains one of the words."""
    def hit(f):
        out = F.lit(False)
        for w in words:
            out = out | f.contains(w)
        return out

    return F.coalesce(F.exists(as_col(flags), hit), F.lit(False))


def keep_flags(flags, kept: list[str]) -> Column:
    return F.filter(F.coalesce(as_col(flags), F.array().cast("array<string>")), lambda f: f.isin(*kept))


def drop_flags(flags, dropped: list[str]) -> Column:
    return F.filter(F.coalesce(as_col(flags), F.array().cast("array<string>")), lambda f: ~f.isin(*dropped))


def flag_list(*pairs: tuple[Column, str]) -> Column:
    """Array of the flags whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(flag)) for cond, flag in pairs]))
