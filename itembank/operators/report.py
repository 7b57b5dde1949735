"""Paper rows, previews, usage and run statistics, progress."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.functions import text as tx
from itembank.operators.ordered import row_numbers
from itembank.operators.skew import attach_per_key

# Texts on a printed paper.
NO_ANSWER_TEXT = "原题未提供答案"
MIN_ELAPSED = 2.0


def paper_rows(selected: DataFrame, order: str = "pos", with_answers: bool = True) -> DataFrame:
    """Lines of a printed paper: numbered stems, lettered options, then the answer key.

    Columns part (0 paper, 1 key), no, line_no and text sort the paper.
    """
    numbered = row_numbers(selected, [], order, "no")
    opts = F.coalesce(F.col("options"), F.array().cast("array<string>"))
    lettered = F.transform(opts, lambda o, i: F.when(o.rlike(r"\A[A-Z][.、．]"), o).otherwise(F.concat(F.char(i + 65), F.lit(". "), o)))
    head = F.concat(F.col("no").cast("string"), F.lit(". "), tx.display_stem(selected))
    body = numbered.select(F.lit(0).alias("part"), "no", F.posexplode(F.concat(F.array(head), lettered)).alias("line_no", "text"))
    if not with_answers:
        return body
    answer = F.coalesce(F.nullif(F.col("answer"), F.lit("")), F.lit(NO_ANSWER_TEXT))
    note = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("explanation", "remark") if c in selected.columns], F.lit(""))
    key_lines = F.filter(F.array(F.concat(F.col("no").cast("string"), F.lit(". "), answer), note), lambda x: x != "")
    key = numbered.select(F.lit(1).alias("part"), "no", F.posexplode(key_lines).alias("line_no", "text"))
    return body.unionByName(key)


def preview(df: DataFrame, widths: dict[str, int], joiner: str = " / ") -> DataFrame:
    """Display projection: every named column cut to its width, arrays joined first."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        value = F.array_join(c, joiner) if kinds[c].startswith("array") else F.coalesce(F.col(c), F.lit(""))
        return F.substring(value, 1, widths[c]).alias(c)

    return df.select((F.col("pos") + 1).alias("id"), *[cell(c) for c in widths])


def token_columns(usage: DataFrame) -> tuple[Column, Column, Column]:
    """Input, output and total tokens over the alias fields; total falls back to the sum of the first pair."""
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in usage.columns], F.lit(0))
    inputs, outputs = first("prompt_tokens", "input_tokens"), first("completion_tokens", "output_tokens")
    fallback = first("prompt_tokens") + first("completion_tokens")
    total = F.coalesce(F.col("total_tokens"), fallback) if "total_tokens" in usage.columns else fallback
    return inputs, outputs, total


def usage_totals(usage: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Tokens and calls per key, with the last call's tokens if an order column is given."""
    i, o, t = token_columns(usage)
    rows = usage.select(*keys, i.alias("i"), o.alias("o"), t.alias("t"), *([F.col(order).alias("ts")] if order else []))
    last = [F.max(F.struct("ts", "t"))["t"].cast("long").alias("last_tokens")] if order else []
    return rows.groupBy(*keys).agg(
        F.sum("i").cast("long").alias("input"), F.sum("o").cast("long").alias("output"),
        F.sum("t").cast("long").alias("total"), F.count(F.lit(1)).alias("calls"), *last,
    )


def run_stats(usage: DataFrame, keys: list[str], failures: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Per run: wall seconds, calls, request seconds, tokens, and whether the run is partial.

    ``usage``: started, seconds, total_tokens. ``failures``: keys. ``docs``: keys, processed_pages, total_pages.
    """
    out = usage.groupBy(*keys).agg(
        (F.max(F.col("started") + F.col("seconds")) - F.min("started")).alias("wall_seconds"),
        F.count(F.lit(1)).alias("calls"), F.sum("seconds").alias("request_seconds"),
        F.sum(F.coalesce("total_tokens", F.lit(0))).cast("long").alias("tokens"),
    )
    partial = F.lit(False)
    if failures is not None:
        out = out.join(failures.groupBy(*keys).agg(F.count(F.lit(1)).alias("failures")), keys, "left").fillna({"failures": 0})
        partial = partial | (F.col("failures") > 0)
    if docs is not None:
        gaps = docs.groupBy(*keys).agg(F.bool_or(F.col("processed_pages") < F.col("total_pages")).alias("__short"))
        out = out.join(gaps, keys, "left")
        partial = partial | F.coalesce(F.col("__short"), F.lit(False))
    return out.withColumn("partial", partial).drop("__short")


def progress(events: DataFrame, now: Column | None = None) -> DataFrame:
    """Progress of every session's current stage: files left and seconds to go.

    ``events``: session, stage, file, fraction, ts (timestamp), event_id, optional total. The current stage is
    the run of events since the stage last changed to it; the latest fraction per file counts.
    Without a ``total`` the files seen are the total.
    """
    order = F.struct("ts", "event_id")
    # The current stage, and the last event of any other stage, follow from one row per (session, stage).
    stages = events.groupBy("session", "stage").agg(F.max(order).alias("k"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    latest = stages.groupBy("session").agg(
        F.max(F.struct("k", "stage"))["stage"].alias("cur"), F.max("ts").alias("last_ts"), F.sum("n").alias("n")
    )
    start = stages.join(latest.select("session", "cur"), "session").filter(F.col("stage") != F.col("cur")).groupBy("session").agg(
        F.max("k").alias("__k")
    )
    stats = latest.join(start, "session", "left")
    since = attach_per_key(events, stats.drop("last_ts"), ["session"], "n", row_id="event_id").filter(
        (F.col("stage") == F.col("cur")) & (F.col("__k").isNull() | (order > F.col("__k")))
    )
    per_file = since.groupBy("session", "file").agg(
        F.max(F.struct(order.alias("k"), "fraction"))["fraction"].alias("fraction"), F.min("ts").alias("started"),
        *([F.max(F.struct(order.alias("k"), "total"))["total"].alias("total")] if "total" in events.columns else []),
    )
    return _summary(per_file, latest.drop("n"), now, "total" in events.columns)


def stage_progress(events: DataFrame) -> DataFrame:
    """Progress of every (session, stage) over all of its events, the batch form of the stream."""
    order = F.struct("ts", "event_id")
    per_file = events.groupBy("session", "stage", "file").agg(
        F.max(F.struct(order.alias("k"), "fraction"))["fraction"].alias("fraction"),
        F.min("ts").alias("started"), F.max("ts").alias("last_ts"),
    )
    g = per_file.groupBy("session", "stage").agg(
        F.count(F.lit(1)).alias("total"), F.sum("fraction").alias("done"), F.count_if(F.col("fraction") >= 1).alias("complete"),
        F.min("started").alias("started"), F.max("last_ts").alias("last_ts"),
    )
    return g.select("session", "stage", "total", *_eta(F.col("last_ts")))


def _eta(now: Column) -> list[Column]:
    elapsed = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6
    done, total = F.col("done"), F.col("total")
    eta = F.when((done > 0) & (elapsed >= MIN_ELAPSED), F.round(elapsed / done * (total - done)).cast("long"))
    return [
        F.round(done, 6).alias("done"),
        F.greatest(F.lit(0), total - F.col("complete")).cast("long").alias("remaining_files"),
        eta.alias("eta_seconds"),
    ]


def _summary(per_file: DataFrame, latest: DataFrame, now: Column | None, has_total: bool) -> DataFrame:
    total = F.max("total") if has_total else F.count(F.lit(1))
    g = per_file.groupBy("session").agg(
        total.alias("total"), F.sum("fraction").alias("done"), F.count_if(F.col("fraction") >= 1).alias("complete"),
        F.min("started").alias("started"),
    ).join(latest, "session")
    return g.select("session", F.col("cur").alias("stage"), "total", *_eta(now if now is not None else F.col("last_ts")))
