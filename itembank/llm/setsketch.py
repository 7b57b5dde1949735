"""Near-duplicates by SetSketch registers: banding, a joint likelihood estimate, and verification on the full sets.

A document is its set of word shingles. Register i of a set is floor(1 - log_b x), x being the least of its elements'
exponential variables under hash i, cut to 16 bits (Ertl, 2021). A set's registers are the register-wise maxima of
those of its parts, and two sets agree in a register about as often as their similarity. Documents with equal sets are one class.

1. Bands of registers bring classes together that agree in all registers of a band. In every bucket one class, chosen
   by a digest, is compared to the others: a row per member, however large the bucket.
2. Before the sets are fetched, the maximum likelihood of the similarity, given both registers and both sizes, rules out
   pairs that lie far below the threshold. The rest is verified: intersection and union of the full sets.
3. Links found form components. Buckets that still hold several components are searched completely: the members outside
   the bucket's largest component against all of other components, in blocks that hold the sets and send on links only.

So no link is lost that shares a band, and members of one component, the bulk of a large group, are never paired.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itembank.llm.common import query, run_folder, slices, stage, table

BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
BASE, RATE = 1.001, 20.0
#: Estimates have a deviation of 0.026 at 0.8 with 240 registers; pairs this far below the threshold are no candidates.
MARGIN = 0.12
#: Words a task remembers; elements of one block of products; members of one block of a bucket.
WORDS = 500_000
PRODUCTS = 1 << 15
MEMBERS = 256
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MULTIPLIERS = _mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _GOLDEN) | np.uint64(1)


class Shingles:
    """Digests of a text's distinct word shingles, sorted. Words are runs of characters other than white space of
    ASCII; A-Z are lower-cased; fewer than ``width`` words are one shingle, no words none."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > WORDS:
            known.clear()
            new = set(words)
        for word in new:
            known[word] = xxhash.xxh3_64_intdigest(word)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(codes))
        mixed = np.full(len(codes) - width + 1, width, np.uint64)
        for i in range(width):
            mixed = _mix(mixed * _GOLDEN + codes[i:len(codes) - width + 1 + i])
        return np.unique(mixed)


def registers(elements: np.ndarray) -> np.ndarray:
    """REGISTERS registers of a set that is not empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, PRODUCTS // min(len(elements), PRODUCTS))
    for low in range(0, len(elements), PRODUCTS):
        part = elements[low:low + PRODUCTS]
        for i in range(0, REGISTERS, step):
            products = np.multiply.outer(MULTIPLIERS[i:i + step], part)
            np.minimum(least[i:i + step], products.min(axis=1), out=least[i:i + step])
    x = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum likelihood of the similarity of sets with registers ``a``, ``b`` (a row each) and sizes ``n_a``, ``n_b``,
    on a grid of hundredths: the numbers of registers greater, less and equal are multinomial."""
    greater, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - greater - less
    u = (n_a / (n_a + n_b))[:, None]
    top = np.minimum(u, 1 - u) / np.maximum(u, 1 - u)
    j = np.minimum(np.arange(101) / 100, top)
    share = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = np.maximum(share(u - (1 - u) * j), 1e-12), np.maximum(share((1 - u) - u * j), 1e-12)
    likelihood = greater * np.log(up) + less * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))
    return np.take_along_axis(j, likelihood.argmax(axis=1)[:, None], 1)[:, 0]


def _sketch(width: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for part in slices(batches, text):
            sizes, digests, sketches = [], [], []
            for content in part.column(text).to_pylist():
                elements = shingles(content)
                sizes.append(len(elements))
                digests.append(xxhash.xxh3_128_digest(elements.tobytes()) if len(elements) else None)
                sketches.append(registers(elements).tobytes() if len(elements) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "n", "digest", "sketch"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _sketches(batch.column("sketch"))
        mixed = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN + np.zeros((len(rows), 1), np.uint64)
        for i in range(ROWS):
            mixed = _mix(mixed ^ rows.reshape(len(rows), BANDS, ROWS)[:, :, i].astype(np.uint64)) + _GOLDEN
        nodes = batch.column("node").to_numpy(zero_copy_only=False)
        bands = np.tile(np.arange(BANDS, dtype=np.int32), len(rows))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, BANDS)), pa.array(mixed.ravel().view(np.int64)), pa.array(bands)], ["node", "bucket", "band"])


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), REGISTERS)


def _plausible(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                n_a, n_b = (part.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                likely = estimate(_sketches(part.column("sketch_a")), _sketches(part.column("sketch_b")), n_a, n_b)
                fits = (likely >= threshold - MARGIN) & (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9)
                yield part.select(["a", "b"]).filter(pa.array(fits))

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices([batch], "set_a")):
            linked = [
                similar(*(np.frombuffer(s.as_buffer(), "<u8") for s in pair), percent) for pair in zip(part.column("set_a"), part.column("set_b"))]
            yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for part in slices(batches, "text"):
            sets = [shingles(t).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "set"])

    return run


def _across(percent: int):
    """Links between two blocks of a bucket, of different components. A pair is compared in the first band it shares."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        threshold = percent / 100
        for batch in batches:
            for i in range(batch.num_rows):
                left, right, band = batch.column("odd")[i].values, batch.column("other")[i].values, batch.column("band")[i].as_py()
                (a, comp_a, n_a), (b, comp_b, n_b) = ([s.field(c).to_numpy() for c in ("node", "comp", "n")] for s in (left, right))
                odd = right.field("is_odd").to_numpy(zero_copy_only=False)
                x, y = _sketches(left.field("sketch")), _sketches(right.field("sketch"))
                found = [[], []]
                for k in range(len(x)):
                    n = np.full(len(y), float(n_a[k]))
                    # Two that are both outside the largest component meet twice.
                    fits = (comp_b != comp_a[k]) & ~(odd & (b < a[k])) & (np.minimum(n, n_b) >= threshold * np.maximum(n, n_b) - 1e-9)
                    at = np.flatnonzero(fits)
                    shared = (y[at].reshape(-1, BANDS, ROWS) == x[k].reshape(BANDS, ROWS)).all(axis=2)
                    at = at[shared.argmax(axis=1) == band]
                    if len(at):
                        at = at[estimate(np.broadcast_to(x[k], (len(at), REGISTERS)), y[at], n[at], n_b[at].astype(float)) >= threshold - MARGIN]
                    if len(at):
                        mine = np.frombuffer(left.field("set")[k].as_buffer(), "<u8")
                        for j in at.tolist():
                            if similar(mine, np.frombuffer(right.field("set")[j].as_buffer(), "<u8"), percent):
                                found[0].append(min(a[k], b[j]))
                                found[1].append(max(a[k], b[j]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["a", "b"])

    return run


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """``node``, ``comp`` (its least node) of all nodes in ``links`` (``a``, ``b``), by alternating large and small stars
    (Kiveris et al., 2014): minima and joins only, so the centre of a large star costs no more than its rows."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    for turn in itertools.count():
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        edges = stage(small.where("u <> v").distinct(), folder, f"{name}-{turn}")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots.select("node", F.col("node").alias("comp")))


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of every row.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles; a component is
    all that links reach, named by its least id; the row of that id is kept. Texts that are null or without words have the empty set and
    are linked with nothing. Rows that repeat an id are one document, linked if any of its texts is, and kept or not
    together: the id links the classes of its texts. A null id is linked with nothing and kept. Other columns are not read.
    """
    folder, limit = run_folder(docs.sparkSession, "near"), percent / 100
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stage(given.mapInArrow(_sketch(width, "text"), "doc_id long, n long, digest binary, sketch binary"), folder, "rows")
    real = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = stage(real.groupBy("digest", "n").agg(F.min("doc_id").alias("node")), folder, "classes")
    nodes = stage(
        real.withColumnRenamed("doc_id", "node").join(classes, ["node", "digest", "n"], "left_semi").select("node", "n", "sketch").dropDuplicates(["node", "sketch"]),
        folder, "nodes")

    # 1: buckets of several classes, with the one that the others are compared to
    banded = nodes.mapInArrow(_bands, "node long, bucket long, band int")
    mixed = F.struct(F.xxhash64("node", "bucket").alias("order"), F.col("node").alias("node"))
    buckets = banded.groupBy("bucket").agg(F.min(mixed)["node"].alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stage(banded.join(buckets, "bucket").select("bucket", "band", "node", "lead", "size"), folder, "members")
    texts = given.withColumnRenamed("doc_id", "node").join(members.select("node").distinct().hint("shuffle_hash"), "node", "left_semi")
    sets = stage(texts.mapInArrow(_shingle_sets(width), "node long, set binary").distinct(), folder, "sets")

    # 2: likelihood, then the sets
    def of(side: str, *columns: str) -> DataFrame:
        return (nodes if "sketch" in columns else sets).select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        full = pairs.join(of("a", "set"), "a").join(of("b", "set"), "b")
        return stage(full.mapInArrow(_verify(percent), "a long, b long").distinct(), folder, name)

    pairs = members.where("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    sketched = pairs.join(of("a", "sketch", "n"), "a").join(of("b", "sketch", "n"), "b")
    links = verified(stage(sketched.mapInArrow(_plausible(limit), "a long, b long").distinct(), folder, "plausible"), "links")

    # 3: buckets that the links leave with several components
    comps = components(links, folder, "comps")
    held = stage(members.join(comps, "node", "left").select("bucket", "band", "node", F.coalesce("comp", "node").alias("comp")), folder, "held")
    by_comp = held.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("size"))
    split = by_comp.groupBy("bucket").agg(F.max(F.struct("size", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("size").alias("all")).where("comps > 1")
    full = nodes.join(sets, "node").where(F.octet_length("set") == 8 * F.col("n"))
    open_ = held.join(split, "bucket").join(full, "node").withColumn("blocks", F.ceil(F.col("all") / MEMBERS))
    is_odd, chunk = F.col("comp") != F.col("main"), F.pmod(F.xxhash64("node"), F.col("blocks"))
    whole = open_.select("bucket", "band", "blocks", chunk.alias("chunk"), is_odd.alias("is_odd"), F.struct("node", "comp", "n", "sketch", "set", is_odd.alias("is_odd")).alias("member"))
    other = whole.groupBy("bucket", "chunk").agg(F.collect_list("member").alias("other"))
    odd = whole.where("is_odd").groupBy("bucket", "band", "chunk", "blocks").agg(F.collect_list("member").alias("odd"))
    met = odd.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("chunk").join(
        other.withColumnRenamed("chunk", "to"), ["bucket", "to"]).select("band", "odd", "other")
    more = stage(met.mapInArrow(_across(percent), "a long, b long").distinct(), folder, "more")
    text_key = F.coalesce("digest", F.lit(b""))  # a text without words has no class, but goes with its id
    several = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text_key).alias("low"), F.max(text_key).alias("high")).where("low <> high").select("doc_id")
    shared = real.select("doc_id", "digest", "n").join(several, "doc_id", "left_semi").join(classes, ["digest", "n"])
    by_id = stage(shared.select(F.least("doc_id", "node").alias("a"), F.greatest("doc_id", "node").alias("b")).distinct(), folder, "by_id")
    final = components(links.union(more).union(by_id), folder, "final")

    named = classes.join(final, "node", "left").select("digest", F.col("n").alias("size"), F.coalesce("comp", "node").alias("comp"))
    out = rows.where("n > 0").join(named, (F.col("n") == F.col("size")) & rows.digest.eqNullSafe(named.digest), "left").select("doc_id", "n", "comp")
    wordless = rows.where("n = 0").join(final, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n", "comp")
    out = out.union(wordless)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


@query()
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by sets of two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"))
