"""Streaming forms: progress state, running usage, idempotent ingest."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from itembank.operators.ingest import ingest_plan, with_fingerprint
from itembank.operators.report import MIN_ELAPSED, token_columns

PROGRESS_OUT = "session long, stage string, total long, done double, remaining_files long, eta_seconds long"
_STATE = "stage string, started double, last double, last_id long, files array<long>, fractions array<double>"


def progress_stream(events: DataFrame) -> DataFrame:
    """Current stage of every session, updated per micro-batch.

    ``events``: session, stage, file, fraction, ts, event_id. State holds the files of the current
    stage only; a stage change drops it. Inside a micro-batch rows are taken in event order, and a
    row older than the state is late and ignored.
    """
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, started, last, last_id, files = None, None, None, -1, {}
        if state.exists:
            stage, started, last, last_id, names, done = state.get
            files = dict(zip(names, done))
        rows = pd.concat(list(batches)).sort_values(["sec", "event_id"])
        for sec, event_id, new_stage, file, fraction in zip(
            rows["sec"], rows["event_id"], rows["stage"], rows["file"], rows["fraction"]
        ):
            if last is not None and (sec, event_id) <= (last, last_id):
                continue
            if new_stage != stage:
                stage, started, files = new_stage, float(sec), {}
            files[int(file)] = float(fraction)
            last, last_id = float(sec), int(event_id)
        if stage is None:
            return
        state.update((stage, started, last, last_id, list(files), list(files.values())))
        total, done = len(files), sum(files.values())
        elapsed = last - started
        eta = round(elapsed / done * (total - done)) if done > 0 and elapsed >= MIN_ELAPSED else None
        yield pd.DataFrame({
            "session": [key[0]], "stage": [stage], "total": [total], "done": [round(done, 6)],
            "remaining_files": [total - sum(x >= 1 for x in files.values())], "eta_seconds": pd.array([eta], dtype="Int64"),
        })

    timed = events.withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return timed.groupBy("session").applyInPandasWithState(
        update, PROGRESS_OUT, _STATE, "update", GroupStateTimeout.NoTimeout
    )


def usage_stream(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Running token totals; state is one row per key."""
    i, o, t = token_columns(usage)
    return usage.groupBy(*keys).agg(
        F.sum(i).cast("long").alias("input"), F.sum(o).cast("long").alias("output"), F.sum(t).cast("long").alias("total"),
        F.count(F.lit(1)).alias("calls"),
    )


def usage_windows(usage: DataFrame, keys: list[str], time: str, window: str, lateness: str) -> DataFrame:
    """Token totals per tumbling window; state of closed windows is dropped by the watermark."""
    i, o, t = token_columns(usage)
    return usage.withWatermark(time, lateness).groupBy(F.window(time, window), *keys).agg(
        F.sum(i).cast("long").alias("input"), F.sum(o).cast("long").alias("output"), F.sum(t).cast("long").alias("total"),
        F.count(F.lit(1)).alias("calls"),
    ).select(*keys, F.col("window.start").alias("start"), "input", "output", "total", "calls")


#: Hex digits of a fingerprint that name its folder: a batch looks into the folders of its own fingerprints only.
PREFIX_DIGITS = 2


def held_fingerprints(spark: SparkSession, bank_path: str, prefixes: list[str], but: int) -> DataFrame:
    """``fingerprint`` of the bank's rows in the folders ``prefixes``, without those of batch ``but``."""
    # Names of folders are text, also where all of them look like numbers.
    stored = spark.read.schema("fingerprint string, batch long, prefix string").parquet(bank_path)
    return stored.filter((F.col("batch") != but) & F.col("prefix").isin(prefixes)).select("fingerprint")


def ingest_stream(items: DataFrame, bank_path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Ingest reviewed rows as they arrive, each fingerprint once. Returns the writer; call ``start``.

    Every micro-batch owns one folder below ``bank_path`` and overwrites it, so replaying a batch
    after a failure adds nothing twice; the bank a batch is checked against leaves its own folder out.
    Inside it rows lie by the first digits of their fingerprint (``batch=…/prefix=…``), and a batch reads the
    folders of the digits it holds itself, of other rows only the fingerprint.
    """
    prefix = F.substring("fingerprint", 1, PREFIX_DIGITS)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = with_fingerprint(prepare(batch) if prepare else batch).persist()
        try:
            # At most 16 ** PREFIX_DIGITS values.
            prefixes = [r[0] for r in rows.filter("fingerprint IS NOT NULL").select(prefix).distinct().collect()]
            try:
                held = held_fingerprints(spark, bank_path, prefixes, batch_id)
            except AnalysisException:  # the first batch meets no bank
                held = spark.createDataFrame([], "fingerprint string")
            added = ingest_plan(held, rows).filter("outcome = 'added'").select(
                "pos", "stem", "options", "answer", "remark", "fingerprint", prefix.alias("prefix"))
            added.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{bank_path}/batch={batch_id}")
        finally:
            rows.unpersist()

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
