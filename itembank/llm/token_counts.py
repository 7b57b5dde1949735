"""Token counts through a digest cache.

A text's cache key is (digest of its normalised content, version of the tokenizer). Counts that the cache holds are
joined; of the rest, one document per digest is encoded, and the new counts are appended to the cache, a Parquet table
partitioned by version. Only keys and counts move with the joins; a text moves once, by its document id, which no
group of copies can make uneven.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.llm import vocab
from itembank.llm.common import query, run_folder, slices, stage, table

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
#: Digests a task remembers, so that it encodes repeated rows of one document once.
SEEN = 500_000


def text_digest(text: str = "text"):
    """Digest of the normalised content: null is the empty text. Ids of byte-level BPE depend on every byte, so nothing
    else may be normalised away."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty table if nothing has been stored yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def _count(path: str | None, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.encoder(path or vocab.tokenizer_path(name))
        seen: set[bytes] = set()
        for part in slices(batches, "text"):
            fresh = []
            for digest in part.column("digest").to_pylist():
                fresh.append(digest not in seen)
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
            part = part.filter(pa.array(fresh, pa.bool_()))
            ids = encoder.encode([t or "" for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column("digest"), pa.array([len(x) // 4 for x in ids], pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(
    docs: DataFrame, cache: str, tokenizer: str = "byte_bpe_50k.json", tokenizer_path: str | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``digest`` of every row of ``docs``.

    ``cache`` is a folder in a shared store; it is created on first use and only ever appended to. Two jobs that miss the
    same text both append its count, as do two tasks if Spark splits the repeated rows of one id; readers take one row per key. Null texts count as empty (0 tokens), texts are
    encoded whole, repeated and null ids are rows like any other, an empty table gives an empty result, other columns
    are not read.
    """
    spark = docs.sparkSession
    version = vocab.version(tokenizer_path or vocab.tokenizer_path(tokenizer))
    folder = run_folder(spark, "counts")
    keys = stage(docs.select(
        F.col(doc_id).alias("doc_id"), text_digest(text).alias("digest"),
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"),
    ), folder, "keys")
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    missing = keys.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("doc_id")).join(known, "digest", "left_anti")
    # One document per missed digest; both columns must agree, as an id may stand on several texts. Equal rows meet in a
    # task by these two, which encodes the first.
    texts = docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), text_digest(text).alias("digest"), F.col(text).alias("text"))
    one = texts.join(missing.hint("shuffle_hash"), ["doc_id", "digest"], "left_semi").select("digest", "text")
    new = one.mapInArrow(_count(tokenizer_path, tokenizer), "digest binary, n_tokens long")
    new.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", "digest")


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents, through a cache that starts empty."""
    counts = count_tokens(table(spark, sf_dir, "documents"), f"{run_folder(spark, 'cache')}/counts")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
