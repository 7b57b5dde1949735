"""Rule-based cleaning: which rows go and why, what the survivors look like."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itembank.functions import text as tx
from itembank.functions.predicates import CONFLICT_FLAGS, flag_list, has_flag
from itembank.operators.skew import attach_per_key

RULES = ["missing_answer", "answer_conflict", "duplicate_stem", "normalize_options"]


def missing_answers(bank: DataFrame) -> DataFrame:
    return bank.filter(tx.ws_key("answer") == "")


def _keyed(bank: DataFrame) -> DataFrame:
    """Keys travel as digests: a shuffle row stays narrow however long the stem is."""
    answer = tx.ws_key("answer")
    return bank.select(
        "*",
        F.sha2(tx.ws_key("stem"), 256).alias("__stem"),
        F.when(answer != "", F.sha2(answer, 256)).alias("__answer"),
        has_flag("review_flags", CONFLICT_FLAGS).alias("__flagged"),
    )


def _stem_stats(keyed: DataFrame, alive) -> DataFrame:
    """Per repeated stem: does it have two answers, and which alive row comes first.

    Grouping by (stem, answer) first makes the distinct count a plain two-step aggregate.
    """
    by_answer = keyed.groupBy("__stem", "__answer").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(alive, F.col("pos"))).alias("first_alive")
    )
    return by_answer.groupBy("__stem").agg(
        F.sum("n").alias("n"), (F.count("__answer") > 1).alias("conflict"), F.min("first_alive").alias("first_alive")
    ).filter("n > 1")


def answer_conflicts(bank: DataFrame) -> DataFrame:
    """All rows of a stem with two different answers, and rows flagged as conflicting."""
    keyed = _keyed(bank)
    rows = attach_per_key(keyed, _stem_stats(keyed, F.lit(True)), ["__stem"], "n")
    return rows.filter(F.col("__flagged") | F.coalesce(F.col("conflict"), F.lit(False))).select(*bank.columns)


def duplicate_stems(bank: DataFrame) -> DataFrame:
    """Every later row of a stem already seen, ignoring whitespace. Case counts."""
    keyed = bank.withColumn("__stem", F.sha2(tx.ws_key("stem"), 256))
    stats = keyed.groupBy("__stem").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")).filter("n > 1")
    rows = attach_per_key(keyed, stats, ["__stem"], "n", how="inner")
    return rows.filter("pos > first_pos").select(*bank.columns)


def _checked(rules: list[str] | None) -> list[str]:
    rules = RULES if rules is None else rules
    if not isinstance(rules, list) or not rules or any(r not in RULES for r in rules):
        raise ValueError("unknown or empty cleaning rules")
    return rules


def with_reasons(bank: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Bank rows with the array of rules that remove them.

    A row that an enabled earlier rule removes neither counts as a first copy nor as a later one.
    """
    rules = _checked(rules)
    keyed = _keyed(bank)
    missing = F.col("__answer").isNull() if "missing_answer" in rules else F.lit(False)
    own_conflict = F.col("__flagged") if "answer_conflict" in rules else F.lit(False)
    rows = attach_per_key(keyed, _stem_stats(keyed, ~missing & ~own_conflict), ["__stem"], "n")
    in_conflict = own_conflict | F.coalesce(F.col("conflict"), F.lit(False))
    conflict = in_conflict if "answer_conflict" in rules else F.lit(False)
    earlier = missing | conflict
    duplicate = ~earlier & (F.col("pos") > F.col("first_alive")) if "duplicate_stem" in rules else F.lit(False)
    reasons = flag_list((missing, "missing_answer"), (conflict, "answer_conflict"), (duplicate, "duplicate_stem"))
    return rows.select(*bank.columns, reasons.alias("reasons"))


def clean(bank: DataFrame, rules: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cleaned rows, removed rows with reasons, one-row report)."""
    rules = _checked(rules)
    marked = with_reasons(bank, rules)
    removed = marked.filter(F.size("reasons") > 0)
    kept = marked.filter(F.size("reasons") == 0).drop("reasons")
    if "normalize_options" in rules:
        kept = normalize_options(kept)
    else:
        kept = kept.withColumn("normalized", F.lit(False))
    return kept.drop("normalized"), removed, report(marked, rules)


def normalize_options(rows: DataFrame) -> DataFrame:
    """Options printed in the stem move out, then every option loses its label. ``normalized`` marks real changes."""
    split = rows.withColumn("__s", tx.split_embedded_options("stem", "options"))
    options = tx.clean_options(F.col("__s.options"))
    changed = F.col("__s.split") | ~options.eqNullSafe(F.coalesce(F.col("options"), F.array().cast("array<string>")))
    return split.withColumn("normalized", changed).withColumn("stem", F.col("__s.stem")).withColumn(
        "options", options
    ).drop("__s")


def report(marked: DataFrame, rules: list[str]) -> DataFrame:
    """Rows before, after and removed, survivors normalised, and a count per rule; a row may have two reasons."""
    gone = F.size("reasons") > 0
    if "normalize_options" in rules:
        marked = normalize_options(marked)
    else:
        marked = marked.withColumn("normalized", F.lit(False))
    per_rule = [
        F.count_if(F.array_contains("reasons", r)).alias(r) for r in RULES if r in rules and r != "normalize_options"
    ]
    return marked.agg(
        F.count(F.lit(1)).alias("before"), F.count_if(~gone).alias("after"), F.count_if(gone).alias("removed"),
        F.count_if(~gone & F.col("normalized")).alias("normalized"), *per_rule,
    )


def clean_counts(marked: DataFrame) -> DataFrame:
    """Rows per removal reason."""
    return marked.select(F.explode("reasons").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
