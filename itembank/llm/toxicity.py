"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic documents (P) and unlabelled ones (U, a sample of everything). With the share of toxic
documents, the class prior, the risk of calling U clean less the prior's share of the risk of calling P clean estimates
the risk on clean documents; where that estimate falls below zero the model has begun to fit noise, and the step goes
back (Kiryo et al., 2017). Features are the distinct words of a text and their first four to six letters, since a stem
takes many endings; those that are not clearly commoner in P than in U are left out before training.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.llm.common import query, run_folder, slices, stage, table

#: Bounds of the sample that is trained on, unless ``fit`` is told others.
POSITIVES = 4000
UNLABELLED = 12000
PREFIXES = (4, 5, 6)
#: A feature is kept if so many P documents hold it, and if it is so many times as frequent in P as in U.
LEAST, TIMES = 4, 3.0
STEPS, RATE, DECAY = 400, 0.05, 1e-3
#: Words whose features a task remembers.
WORDS = 400_000
WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    keys = {word} | {f"{word[:n]}*" for n in PREFIXES if len(word) >= n}
    return [zlib.crc32(k.encode("utf-8", "replace")) for k in keys]


def features(text: str | None) -> set[int]:
    return {f for w in set(WORD.findall((text or "").lower())) for f in word_features(w)}


class Classifier:
    """weights: of the kept features, by feature."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, list[int]] = {}

    def score(self, text: str | None) -> float:
        words = set(WORD.findall((text or "").lower()))
        for word in words.difference(self.known):
            if len(self.known) >= WORDS:
                self.known.clear()
            self.known[word] = [f for f in word_features(word) if f in self.weights]
        held = {f for w in words for f in (self.known.get(w) or ())}
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(self.weights[f] for f in sorted(held)), -30, 30))))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(kept: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Classifier:
    """A linear classifier on the features ``kept``, from the places in it of each document's features, for both samples."""
    def sparse(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs).astype(np.int64)

    (row_p, col_p), (row_u, col_u) = sparse(positive), sparse(unlabelled)
    w, mean, square = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    w[-1] = np.log(prior / (1 - min(prior, 0.999)))

    def gradient(row: np.ndarray, col: np.ndarray, by_row: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(col, by_row[row], len(kept)), by_row.sum())

    for step in range(1, STEPS + 1):
        g_p = np.bincount(row_p, w[col_p], len(positive)) + w[-1]
        g_u = np.bincount(row_u, w[col_u], len(unlabelled)) + w[-1]
        down_p, down_u = _sigmoid(g_p) / len(positive), _sigmoid(g_u) / len(unlabelled)
        clean = gradient(row_u, col_u, down_u) - prior * gradient(row_p, col_p, down_p)
        if _softplus(g_u).mean() - prior * _softplus(g_p).mean() >= 0:
            slope = prior * gradient(row_p, col_p, down_p - 1 / len(positive)) + clean
        else:
            slope = -clean
        slope[:-1] += DECAY * w[:-1]
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope * slope
        w -= RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return Classifier(dict(zip(kept.tolist(), w[:-1].tolist())), float(w[-1]))


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learned; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        made = [np.array(sorted(features(t)), "<u4").tobytes() for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(made, pa.binary())], ["toxic", "features"])


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for batch in batches for p in slices([batch], "features")):
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(part.column("features").to_pylist()), "<u4").astype(np.int64))], ["feature"])


def _hits(kept: np.ndarray):
    """The places in ``kept`` (ascending) of each document's features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices([batch], "features")):
            hits = []
            for held in part.column("features").to_pylist():
                _, places, _ = np.intersect1d(kept, np.frombuffer(held, "<u4"), assume_unique=True, return_indices=True)
                hits.append(places.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(hits, pa.binary())], ["toxic", "hits"])

    return run


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """Train on at most ``positives`` confirmed toxic documents and about ``unlabelled`` documents of any kind, both chosen by a
    digest of the id outside the held-out fold. The prior is the share of toxic ones among the labelled outside it.

    Features are counted by Spark; to the driver come those that are kept, and of each document of the sample the places of its own among them.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.col("toxic").isNotNull())
    total, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic:
        return Classifier({}, -30.0)
    mixed = F.xxhash64("doc_id", F.lit("sample"))
    positive = known.where("toxic = 1").orderBy(mixed, "doc_id").limit(positives).select("doc_id")
    rest = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, unlabelled / max(1, rest.count()))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("rest")), F.lit(1 << 30)) < int(share * (1 << 30))
    # The ids of P are at most ``positives`` rows.
    marked = rest.select("doc_id", "text", chosen.alias("chosen")).join(F.broadcast(positive.withColumn("toxic", F.lit(True))), "doc_id", "left")
    marked = marked.where(F.col("chosen") | F.col("toxic")).withColumn("toxic", F.coalesce("toxic", F.lit(False)))
    rows = marked.select("text", F.when(F.col("toxic") & F.col("chosen"), 2).when(F.col("toxic"), 1).otherwise(0).alias("toxic"))
    sample = stage(rows.mapInArrow(_featurise, "toxic int, features binary"), run_folder(docs.sparkSession, "toxicity"), "sample")
    in_sample = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_p, n_u = in_sample.get(1, 0) + in_sample.get(2, 0), in_sample.get(0, 0) + in_sample.get(2, 0)
    if not n_p or not n_u:
        return Classifier({}, -30.0)

    counts = lambda kinds: sample.where(F.col("toxic").isin(*kinds)).mapInArrow(_explode, "feature long").groupBy("feature")
    often = counts((1, 2)).agg(F.count(F.lit(1)).alias("in_p")).where(F.col("in_p") >= min(LEAST, n_p))
    common = often.join(counts((0, 2)).agg(F.count(F.lit(1)).alias("in_u")), "feature", "left")
    clear = F.col("in_p") / n_p >= TIMES * (F.coalesce("in_u", F.lit(0)) + 1) / (n_u + 1)
    kept = np.sort(np.array([r["feature"] for r in common.where(clear).select("feature").collect()], "<u4"))
    hits = [(r["toxic"], np.frombuffer(r["hits"], "<u4")) for r in sample.mapInArrow(_hits(kept), "toxic int, hits binary").collect()]
    of = lambda kinds: [places for kind, places in hits if kind in kinds]
    return train(kept, of((1, 2)), of((0, 2)), toxic / total)


def _score(weights: dict[int, float], bias: float, text: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(weights, bias)
        for part in slices(batches, text):
            scores = pa.array([model.score(t) for t in part.column(text).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), scores], [*kept, "score"])

    return run


def score(docs: DataFrame, model: Classifier, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of every row and ``score`` of its whole text, 0 to 1; no shuffle.

    A null or empty text has no features and gets the bias's score; repeated rows get equal scores. A model without
    positive examples scores everything next to 0. Only the text is an input.
    """
    schema = docs.select(*keep).withColumn("score", F.lit(0.0)).schema
    read = list(dict.fromkeys([*keep, text]))
    return docs.select(*read).mapInArrow(_score(model.weights, model.bias, text, keep), schema)


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
