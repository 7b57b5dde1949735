"""Batch calls of a user-supplied model function, cached by content."""
from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itembank.functions import text as tx
from itembank.operators.skew import attach_per_key

ATTEMPTS = 3
RESULT = "key string, response string, status string, error string, attempts int, seconds double, prompt_tokens long, completion_tokens long, total_tokens long"


def request_key(version: str, model: str, endpoint: str, task: str, policy: dict, prompt, image=None) -> Column:
    """Cache key of a request: everything that can change the reply, as one digest."""
    head = version + model + endpoint + task + json.dumps(policy, sort_keys=True)
    image = F.lit(b"") if image is None else F.coalesce(tx.as_col(image), F.lit(b""))
    return F.sha2(F.concat(F.lit(head).cast("binary"), tx.as_col(prompt).cast("binary"), image), 256)


def call_model(requests: DataFrame, fn: Callable[[str], dict], concurrency: int, wait: float = 1.0) -> DataFrame:
    """Call ``fn`` once per row, at most ``concurrency`` rows at a time.

    ``fn(prompt)`` returns ``{"content", "finish_reason", "usage"}``. Transport and JSON errors are
    tried again after 1 and 2 waits; a truncated reply is an error at once. A failure marks its row.
    """
    def one(key: str, prompt: str) -> tuple:
        begun = time.monotonic()
        for attempt in range(1, ATTEMPTS + 1):
            try:
                reply = fn(prompt)
                usage = reply.get("usage") or {}
                tokens = [usage.get(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens")]
                spent = time.monotonic() - begun
                if reply.get("finish_reason") == "length":
                    return (key, None, "error", "truncated", attempt, spent, *tokens)
                json.loads(reply["content"])
                return (key, reply["content"], "ok", None, attempt, spent, *tokens)
            except (OSError, json.JSONDecodeError) as exc:
                error = type(exc).__name__
                if attempt < ATTEMPTS:
                    time.sleep(wait * 2 ** (attempt - 1))
            except Exception as exc:  # a bad reply fails its row, never the batch
                return (key, None, "error", type(exc).__name__, attempt, time.monotonic() - begun, None, None, None)
        return (key, None, "error", error, ATTEMPTS, time.monotonic() - begun, None, None, None)

    columns = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([one(k, p) for k, p in zip(pdf["key"], pdf["prompt"])], columns=columns)
            for c in ("prompt_tokens", "completion_tokens", "total_tokens"):
                out[c] = out[c].astype("Int64")
            yield out

    return requests.select("key", "prompt").repartition(concurrency, "key").mapInPandas(run, RESULT)


def cached_infer(df: DataFrame, fn: Callable[[str], dict], cache: DataFrame | None, concurrency: int, wait: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(rows with their reply, new replies to append to the cache table).

    ``df`` has ``key`` and ``prompt``; equal keys are called once. Only good replies are reused.
    The caller writes the new replies before using the rows, so a lost executor repeats no call:
    see ``infer_to_table``.
    """
    distinct = df.groupBy("key").agg(F.first("prompt").alias("prompt"))
    todo = distinct if cache is None else distinct.join(cache.filter("status = 'ok'").select("key"), "key", "left_anti")
    fresh = call_model(todo, fn, concurrency, wait)
    known = fresh if cache is None else fresh.unionByName(cache.filter("status = 'ok'"), allowMissingColumns=True)
    return attach_replies(df, known), fresh


def attach_replies(df: DataFrame, known: DataFrame) -> DataFrame:
    replies = known.select("key", "response", "status", "error")
    return attach_per_key(df, replies, ["key"], row_id=df.columns[0])


def infer_to_table(df: DataFrame, fn: Callable[[str], dict], path: str, concurrency: int, wait: float = 1.0) -> DataFrame:
    """Call the model for the keys the table at ``path`` lacks, append the replies, and read them back.

    Downstream plans start from the stored replies, so recomputing a lost stage calls nothing twice.
    """
    spark = df.sparkSession
    try:
        cache = spark.read.schema(RESULT).parquet(path)
    except AnalysisException:  # no reply has been stored yet
        cache = None
    _, fresh = cached_infer(df, fn, cache, concurrency, wait)
    fresh.write.mode("append").parquet(path)
    stored = spark.read.schema(RESULT).parquet(path)
    # A key that failed before and succeeded now has both rows; the good one counts.
    best = stored.groupBy("key").agg(F.max(F.struct((F.col("status") == "ok").alias("good"), "response", "status", "error")).alias("r"))
    return attach_replies(df, best.select("key", "r.response", "r.status", "r.error"))


def retry_missing(expected: DataFrame, first: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(findings of both rounds, ids still uncovered).

    ``expected`` and replies share ``id``; ``ask`` takes the uncovered rows and returns replies with
    ``id`` and ``finding``. Findings of round one are kept.
    """
    uncovered = expected.join(first.select("id"), "id", "left_anti")
    second = ask(uncovered)
    answered = second.join(uncovered.select("id"), "id", "left_semi")
    findings = first.join(expected.select("id"), "id", "left_semi").withColumn("round", F.lit(1)).unionByName(
        answered.withColumn("round", F.lit(2))
    )
    return findings, uncovered.join(answered.select("id"), "id", "left_anti")
