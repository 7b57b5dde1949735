"""From documents to token ids: each stage keeps its decisions and hands on documents; the last adds tokens.

    toxicity          documents that score 0.5 or more go
    near_duplicates   one document of each component stays, the one with the least id
    repeats           bytes of passages that also start earlier go; what is left stays, though it be empty
    mixture           sources come to their target weights: a document stands as often as the mix takes it
    sentencepiece     ids of every text, and the text that they decode to
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.llm import mixing, pieces, setsketch, toxicity
from itembank.llm.common import run_folder, stage, table
from itembank.llm.repeats import without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.5. A null or empty text scores as the bias has it, so it stays."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, docs.columns).where("score < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least id of each component; rows without an id and texts without words stay. Shingles are of five
    words, links from 0.8."""
    kept = setsketch.near_duplicates(docs, width=5).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    # A text goes to its id; ids are narrow and are the side that is held in memory.
    return docs.where("doc_id IS NOT NULL").join(kept.hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns).union(
        docs.where("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without repeated strings of 100 bytes, ``n_chars`` anew."""
    rest = without_repeats(docs, [c for c in docs.columns if c != "text"], with_text=True)
    return rest.withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its text, to the nearest whole number; empty texts are never taken. Rows that
    share an id are told apart by a digest of all columns; of equal rows, each stands as often as the one taken most."""
    key = F.xxhash64(*docs.columns)
    mixed = mixing.mix(docs, row_key=key).where("size > 0").withColumn("copies", F.round(F.col("taken") / F.col("size")).cast("int"))
    copies = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")).agg(F.max("copies").alias("copies")).where("copies > 0")
    taken = docs.withColumn("row_key", key).join(
        copies.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_key") == F.col("__key")))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source``, ``lang``, ``n_tokens``, ``ids`` and the ``decoded`` text of every row."""
    return pieces.encode_decode(docs, ["doc_id", "source", "lang"], ["n_tokens", "ids", "decoded"])


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats),
    ("mixture", mix_sources), ("sentencepiece", tokenise),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    folder, docs = run_folder(spark, "pipeline"), table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), folder, name)
    return docs
