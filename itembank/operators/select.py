"""Search, boolean selection, quotas and the working pool."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.functions import query as qy
from itembank.functions import text as tx
from itembank.operators.quota import greedy_quotas

# What a request from a form may ask for; None lifts them.
MAX_GROUPS = 30
MAX_COUNT = 500
DEFAULT_COUNT = 20
#: Chosen rows are broadcast up to so many.
BROADCAST_ROWS = 15_000


def _corpus(words: list[str]) -> Column:
    """Search text; whitespace is only normalised if some keyword could see it."""
    return tx.search_corpus("stem", "answer", "remark", "image", "options", collapse=any(" " in w for w in words))


def search_hits(bank: DataFrame, text: str, compat: bool = False) -> DataFrame:
    """All rows matching the search box text."""
    tokens, mode = qy.search_tokens(text, compat)
    if not tokens:
        return bank
    asked = qy.flat_query(tokens, mode == "AND")
    return bank.filter(tx.once(_corpus(tokens), lambda x: qy.matches(asked, x)))


def search(bank: DataFrame, text: str = "", limit: int = 80, compat: bool = False) -> DataFrame:
    """Result page: first hits in bank order, or the newest rows for an empty search."""
    tokens, _ = qy.search_tokens(text, compat)
    order = F.col("pos").asc() if tokens else F.col("pos").desc()
    return search_hits(bank, text, compat).orderBy(order).limit(limit).select(
        (F.col("pos") + 1).alias("id"),
        F.substring("stem", 1, 90).alias("stem"),
        F.substring(F.array_join("options", " / "), 1, 120).alias("options"),
        F.substring("answer", 1, 20).alias("answer"),
        F.substring("remark", 1, 120).alias("remark"),
        "image",
        tx.choice_label(F.col("pos") + 1, "stem", "answer").alias("label"),
    )


def search_counts(bank: DataFrame, text: str = "", limit: int = 80, compat: bool = False) -> DataFrame:
    """Rows shown, rows hit, rows in the bank, in one scan."""
    tokens, mode = qy.search_tokens(text, compat)
    asked = qy.flat_query(tokens, mode == "AND")
    hit = tx.once(_corpus(tokens), lambda x: qy.matches(asked, x)) if tokens else F.lit(True)
    return bank.agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("total")).select(
        F.least(F.col("hits"), F.lit(limit)).alias("shown"), "hits", "total"
    )


def recent(bank: DataFrame, n: int = 80) -> DataFrame:
    """Newest rows first; a top-k, not a sort."""
    return bank.orderBy(F.col("pos").desc()).limit(n)


def matching(bank: DataFrame, tree: dict, exclude: list[str] | None = None) -> DataFrame:
    """Rows matching a lenient tree and none of the excluded words."""
    tree, words = qy.compile_query(tree), qy.keyword_list(exclude or [])
    corpus = _corpus(qy.words_of(tree) + words)
    return bank.filter(tx.once(corpus, lambda x: qy.matches(tree, x) & ~qy.contains_any(x, words)))


def scored_select(bank: DataFrame, tree: dict, exclude: list[str] | None = None, n: int = 50, boosts=None) -> DataFrame:
    """Best ``n`` matches by keyword score, ties in bank order."""
    tree, words = qy.compile_query(tree), qy.keyword_list(exclude or [])
    extra = [w for group, _ in (qy.DEFAULT_BOOSTS if boosts is None else boosts) for w in group]
    corpus = _corpus(qy.words_of(tree) + words + extra)
    # Match and score come from one look at the text; a row without a match explodes to nothing.
    score = F.transform(F.array(corpus), lambda x: F.when(
        qy.matches(tree, x) & ~qy.contains_any(x, words), qy.query_score(tree, x, boosts)
    ))
    hits = bank.select("*", F.explode(F.array_compact(score)).alias("score"))
    return hits.orderBy(F.col("score").desc(), "pos").limit(max(1, n))


def keyword_select(bank: DataFrame, must: list[str], anyof: list[str], exclude: list[str] | None = None, n: int = 50) -> DataFrame:
    return scored_select(bank, {"must_keywords": must, "any_keywords": anyof}, exclude, n)


def _checked_groups(groups: list[dict], max_groups: int | None, max_count: int | None) -> list[dict]:
    if not groups or (max_groups is not None and len(groups) > max_groups):
        raise ValueError(f"1 to {max_groups} selection groups" if max_groups else "at least one selection group")
    out = []
    for g in groups:
        count = int(g.get("count", DEFAULT_COUNT))
        if count < 1 or (max_count is not None and count > max_count):
            raise ValueError(f"1 to {max_count} rows per group" if max_count else "at least one row per group")
        out.append({**g, "count": count})
    return out


def _sent(chosen: DataFrame, counts: list[int]) -> DataFrame:
    """The chosen rows as a side of a join: sent to all tasks if the request asks for few."""
    return F.broadcast(chosen) if sum(counts) <= BROADCAST_ROWS else chosen


def quota_select(
    bank: DataFrame, groups: list[dict], exclude: list[str] | None = None, compat: bool = False, *,
    max_groups: int | None = MAX_GROUPS, max_count: int | None = MAX_COUNT,
) -> tuple[DataFrame, DataFrame]:
    """(selected rows, report): groups in order take their first hits not chosen earlier."""
    groups = _checked_groups(groups, max_groups, max_count)
    counts = [g["count"] for g in groups]
    corpus = tx.select_corpus("stem", "options", "category_tags", "remark", compat)

    def hits(x: Column) -> Column:
        out = []
        for i, g in enumerate(groups):
            words = g.get("exclude_keywords", exclude or [])
            keep = qy.matches(qy.compile_query(g["query"], strict=True), x, "casefold") & ~qy.contains_any(x, words, "casefold")
            out.append(F.when(keep, F.lit(i)))
        return F.array_compact(F.array(*out))

    # One pass over the bank evaluates every group on one look at the text.
    member = bank.select("pos", tx.once(corpus, hits).alias("groups"))
    chosen = greedy_quotas(member, counts, ["pos"])
    selected = bank.join(_sent(chosen, counts), "pos").withColumn("stem", tx.display_stem(bank))
    return selected, selection_report(member, chosen, counts)


def selection_report(member: DataFrame, chosen: DataFrame, counts: list[int]) -> DataFrame:
    """Requested, matched (hits no earlier group took), selected and shortfall per group."""
    taken = _sent(chosen.select("pos", "sel_group"), counts)
    hits = member.select("pos", F.explode("groups").alias("grp_no")).join(taken, "pos", "left").filter(
        F.col("sel_group").isNull() | (F.col("sel_group") >= F.col("grp_no"))
    )
    matched = hits.groupBy("grp_no").agg(
        F.count(F.lit(1)).alias("matched"), F.count_if(F.col("sel_group") == F.col("grp_no")).alias("selected")
    )
    spark = member.sparkSession
    asked = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "grp_no int, requested int")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return asked.join(matched, "grp_no", "left").select(
        F.col("grp_no").alias("sel_group"), "requested", zero("matched").alias("matched"),
        zero("selected").alias("selected"), (F.col("requested") - zero("selected")).alias("shortfall"),
    )


def score_errors(scores: DataFrame, bank: DataFrame, n_groups: int) -> DataFrame:
    """Score rows that may not be used (unknown or repeated id, bad score, bad group, blank reason) and bank rows without a score."""
    known = bank.select("pos", F.lit(True).alias("__known"))
    repeats = scores.groupBy("pos").agg(F.count(F.lit(1)).alias("__n"))
    checked = scores.join(repeats, "pos").join(known, "pos", "left")
    bad_group = (F.size("groups") < 1) | F.exists("groups", lambda g: g.isNull() | (g < 0) | (g >= n_groups))
    faults = checked.withColumn(
        "error",
        F.when(F.col("__known").isNull(), "unknown id")
        .when(F.col("__n") > 1, "repeated id")
        .when(F.coalesce(~F.col("score").between(0, 1) | F.isnan("score"), F.lit(True)), "score")
        .when(F.coalesce(bad_group, F.lit(True)), "group")
        .when(F.coalesce(tx.strip("reason") == "", F.lit(True)), "reason"),
    ).filter("error IS NOT NULL").drop("__n", "__known")
    unscored = bank.select("pos").join(scores.select("pos"), "pos", "left_anti").withColumn("error", F.lit("no score"))
    return faults.unionByName(unscored, allowMissingColumns=True)


def score_quota_select(
    bank: DataFrame, scores: DataFrame, groups: list[dict], *, max_groups: int | None = MAX_GROUPS, max_count: int | None = MAX_COUNT,
) -> tuple[DataFrame, DataFrame]:
    """(selected rows awaiting review, report): per group the best scores not chosen earlier.

    ``scores`` are those ``score_errors`` finds no fault with. A null score or group takes no part.
    """
    counts = [g["count"] for g in _checked_groups(groups, max_groups, max_count)]
    asked = F.array_sort(F.array_distinct(F.filter("groups", lambda g: g.between(0, len(counts) - 1)))).cast("array<int>")
    member = scores.where("score IS NOT NULL").select("pos", (-F.col("score")).alias("__low"), asked.alias("groups"))
    chosen = greedy_quotas(member, counts, ["__low", "pos"])
    picked = _sent(_sent(chosen, counts).join(scores.select("pos", "score", "reason"), "pos"), counts)
    selected = bank.join(picked, "pos").withColumn("stem", tx.display_stem(bank)).withColumn(
        "selection_review",
        F.struct(
            F.lit("pending").alias("status"), F.col("reason"), F.col("pos").alias("source_index"),
            F.col("score"), F.col("sel_group").alias("group"),
        ),
    )
    return selected, selection_report(member, chosen, counts).drop("matched")


# --- working pool -----------------------------------------------------------------------------

def pool_add(pool: DataFrame, checked: DataFrame) -> DataFrame:
    """Ordered union without repeats: pool rows keep their place, new ids follow in checked order."""
    both = pool.select("pos", F.lit(0).alias("side"), "ord").unionByName(
        checked.select("pos", F.lit(1).alias("side"), "ord")
    )
    first = both.groupBy("pos").agg(F.min(F.struct("side", "ord")).alias("k"))
    return first.select("pos", F.col("k.side").alias("side"), F.col("k.ord").alias("ord"))


def pool_remove(pool: DataFrame, checked: DataFrame) -> DataFrame:
    return pool.join(checked.select("pos"), "pos", "left_anti")


def export_filter(selection: DataFrame) -> DataFrame:
    """Accepted rows; the job fails if any review is pending."""
    status = F.coalesce(F.col("selection_review.status"), F.lit("accepted"))
    guarded = selection.withColumn(
        "__ok", F.when(status == "pending", F.raise_error(F.lit("review every selected row before export"))).otherwise(F.lit(True))
    )
    return guarded.filter(F.col("__ok") & (status != "rejected")).drop("__ok")
