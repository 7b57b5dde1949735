"""Gated, idempotent ingest of reviewed questions into the bank."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.functions import predicates as pr
from itembank.functions import text as tx
from itembank.operators.skew import attach_per_key

OUTCOMES = ["added", "discarded", "missing_answer", "duplicates", "pending_review"]


def with_fingerprint(rows: DataFrame) -> DataFrame:
    """Rows with their content hash; a stored one is used as it is, so only that column is read."""
    if "fingerprint" in rows.columns:
        return rows
    return rows.withColumn("fingerprint", tx.content_digest(tx.display_stem(rows), "options"))


def gate() -> Column:
    """First gate a row fails; null lets it through to the duplicate check."""
    open_figure = F.col("suspected") & (F.coalesce(F.col("figure_status"), F.lit("")) != "confirmed")
    shape = F.size(tx.format_flags("stem", "options", tx.normalize_answer("answer"))) > 0
    return (
        F.when(pr.discarded("status"), "discarded")
        .when(pr.missing("answer"), "missing_answer")
        .when(open_figure | pr.filled("review_flags") | shape, "pending_review")
    )


def ingest_plan(bank: DataFrame, result: DataFrame, partial: bool = False, allow_partial: bool = False) -> DataFrame:
    """Result rows with their outcome. A partial result is refused unless allowed.

    The first eligible row of a fingerprint that the bank does not hold is added; all others are
    duplicates. First rows come from a combinable minimum, so a fingerprint shared by many rows
    costs one row per task.
    """
    if partial and not allow_partial:
        raise ValueError("the result is partial; allow it explicitly")
    rows = with_fingerprint(result).withColumn("__gate", gate())
    eligible = rows.filter("__gate IS NULL")
    first = eligible.groupBy("fingerprint").agg(F.min("pos").alias("pos"))
    held = with_fingerprint(bank).select("fingerprint").distinct()
    # One row per fingerprint on both sides, and the winners return to the rows by unique id.
    winners = first.join(held, "fingerprint", "left_anti").select("pos", F.lit(True).alias("__win"))
    out = rows.join(winners, "pos", "left")
    outcome = F.when(F.col("__gate").isNotNull(), F.col("__gate")).when(F.col("__win"), "added").otherwise("duplicates")
    return out.withColumn("outcome", outcome).drop("__gate", "__win")


def ingest_outcome(plan: DataFrame, bank: DataFrame | None = None) -> DataFrame:
    """Counts per outcome, rows skipped, and the bank size afterwards."""
    rows = plan.select("outcome")
    if bank is not None:
        rows = rows.unionByName(bank.select(F.lit("held").alias("outcome")))
    outcome = F.col("outcome")
    counts = rows.agg(
        *[F.count_if(outcome == o).alias(o) for o in OUTCOMES], F.count_if(~outcome.isin("added", "held")).alias("skipped"),
        F.count_if(outcome.isin("added", "held")).alias("total"),
    )
    return counts if bank is not None else counts.drop("total")


def to_bank_rows(items: DataFrame, run_id: str) -> DataFrame:
    """Bank record: clean stem and options, tags and explanation as remark, provenance."""
    source = [F.col(c) for c in ("source_file", "source_hash", "source_pages", "number", "section", "answer_source", "review_flags") if c in items.columns]
    remark = F.concat(tx.tag_line("category_tags"), F.lit("\n"), F.coalesce(F.col("explanation"), F.lit("")))
    keep = [c for c in ("pos", "image", "images", "fingerprint") if c in items.columns]
    return items.select(
        *keep, tx.display_stem(items).alias("stem"), tx.clean_options("options").alias("options"),
        F.coalesce(F.col("answer"), F.lit("")).alias("answer"), remark.alias("remark"),
        F.struct(*source).alias("agent_source"), F.lit(run_id).alias("agent_run"),
    )


def records_from_form(rows: DataFrame, checked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, counts) from flat form rows.

    ``rows``: row_no, stem, options (text, one per line), answer, tags (text), remark, image.
    Tags missing from the remark go to its front, empty stems are skipped, and only the checked row
    numbers are taken if given.
    """
    if checked is not None:
        rows = rows.join(checked.select("row_no"), "row_no", "left_semi")
    tags = tx.tag_list("tags")
    line = tx.tag_line(tags)
    remark = tx.strip(F.coalesce(F.col("remark"), F.lit("")))
    # A remark that starts with a tag line only takes the tags it lacks, each put in front.
    absent = F.aggregate(tags, remark, lambda acc, t: F.when(acc.contains(F.concat(F.lit("#"), t)), acc).otherwise(F.concat(F.lit("#"), t, F.lit(" "), acc)))
    merged = (
        F.when(line == "", remark)
        .when(remark.startswith("#"), absent)
        .otherwise(tx.strip(F.concat(line, F.lit("\n"), remark)))
    )
    built = rows.select(
        "row_no", tx.strip("stem").alias("stem"), tx.strip(F.coalesce(F.col("image"), F.lit(""))).alias("image"),
        tx.option_lines(F.coalesce(F.col("options"), F.lit(""))).alias("options"),
        tx.strip(F.coalesce(F.col("answer"), F.lit(""))).alias("answer"), merged.alias("remark"),
    )
    blank = F.coalesce(F.col("stem"), F.lit("")) == ""
    counts = built.agg(F.count_if(~blank).alias("saved"), F.count_if(blank).alias("skipped"))
    return built.filter(~blank), counts


def diff_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fingerprints added, removed or changed (same fingerprint, other answer or remark) between two versions.

    Rows with equal fingerprints are compared as a multiset digest, so order does not matter.
    """
    def digest(df: DataFrame, side: str) -> DataFrame:
        content = F.xxhash64(F.coalesce("answer", F.lit("")), F.coalesce("remark", F.lit("")))
        return with_fingerprint(df).groupBy("fingerprint").agg(
            F.count(F.lit(1)).alias(f"n_{side}"), F.bit_xor(content).alias(f"x_{side}"),
            F.sum(content.cast("decimal(38,0)")).alias(f"s_{side}"),
        )

    both = digest(old, "old").join(digest(new, "new"), "fingerprint", "full")
    same = (F.col("n_old") == F.col("n_new")) & (F.col("x_old") == F.col("x_new")) & (F.col("s_old") == F.col("s_new"))
    change = (
        F.when(F.col("n_old").isNull(), "added").when(F.col("n_new").isNull(), "removed").when(~same, "changed")
    )
    return both.select(
        "fingerprint", change.alias("change"), F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new")
    ).filter("change IS NOT NULL")


def duplicates_in_bank(bank: DataFrame, result: DataFrame) -> DataFrame:
    """Result rows whose content the bank already holds."""
    held = with_fingerprint(bank).groupBy("fingerprint").agg(F.min("pos").alias("bank_pos"))
    return attach_per_key(with_fingerprint(result), held, ["fingerprint"], how="inner")
