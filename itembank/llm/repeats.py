"""Repeated passages by suffix arrays: bytes covered by a string of ``length`` bytes that also starts earlier.

Suffixes that share ``length`` bytes share every substring of them, so they can be brought together by content:

1. A window (a string of ``length`` bytes) is owned by its anchor: the least digest among its substrings of ``GRAM``
   bytes. Neighbouring windows mostly have one anchor in common; such a run of windows is a segment. Equal windows have
   equal anchors, so only segments with equal anchors need comparing. Of equal segments, all but the first are repeats
   as a whole; that is settled per task before the shuffle, then per anchor on sorted rows.
2. Anchors with different segments are left, and of each segment its first place. Their bytes are fetched and put
   together by anchor, in suffix arrays built by two-stage sorting (Itoh and Tanaka, 1999): suffixes smaller than their
   successors are sorted directly, and the others are induced by scans of buckets. Windows with a common prefix of
   ``length`` with their neighbours in the array are equal; all but the first are repeats.
3. An anchor with more than ``CROWD`` different segments (the rim of a passage that stands in very many contexts) would be
   too much for one array. Its windows are compared by digest instead, in an aggregation that combines before the shuffle.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.llm.common import query, run_folder, slices, stage, table

LENGTH = 100
GRAM = 32
CROWD = 4096
#: Windows of one piece of a long text; bytes of one suffix array; rows of one anchor that a task holds back.
PIECE = 1 << 19
ARRAY_BYTES = 1 << 20
HELD = 1 << 17
NO_ID = -(1 << 63)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOW = np.uint64((1 << 20) - 1)

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        ones = np.ones(n, np.uint64)
        _powers[:] = [np.multiply.accumulate(np.where(np.arange(n) > 0, b, ones)) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def segments(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor digest, segment digest, first window, number of windows) of each segment of a text."""
    n_windows = len(raw) - length + 1
    if n_windows > PIECE:
        parts = []
        for low in range(0, n_windows, PIECE):
            a, s, at, n = segments(raw[low:low + PIECE + length - 1], length, gram)
            parts.append((a, s, at + low, n))
        return tuple(np.concatenate(c) for c in zip(*parts))
    if n_windows <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none
    power, inverse = powers(len(raw) + 1)
    # A digest of raw[a:b] is (sums[b] - sums[a]) / base**a, then mixed.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[np.frombuffer(raw, np.uint8)] * power[:len(raw)], dtype=np.uint64)])

    def digest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (sums[b] - sums[a]) * inverse[a]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    starts = np.arange(len(raw) - gram + 1)
    grams = digest(starts, starts + gram)
    # The place in the low bits makes the leftmost of equal digests the least.
    least = (grams & ~_LOW) | starts.astype(np.uint64)
    wide, step = length - gram + 1, 1
    while 2 * step <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    owner = np.minimum(least[:n_windows], least[wide - step:wide - step + n_windows]) & _LOW
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    count = np.diff(np.append(first, n_windows))
    return (grams[owner[first].astype(np.int64)].view(np.int64), digest(first, first + count - 1 + length).view(np.int64), first, count)


#: ``key``: digest of the text, which tells apart the texts of one id.
COLUMNS = ["kind", "anchor", "segment", "doc", "at", "n", "key"]
SCHEMA = "kind int, anchor long, segment long, doc long, at long, n long, key long"
PLACE = [2, 3, 5]
REPEAT, FIRST, CROWDED = 0, 1, 2


def _batch(kind: int, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows.shape[1], kind, np.int32)), *map(pa.array, rows)], COLUMNS[:1 + len(rows)])


def split_repeats(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each (anchor, segment), the others) of columns sorted by anchor, segment, doc, key, at. A row at the
    place of the first is the first again, from a row that repeats."""
    place = rows[PLACE[:len(rows) - 3]]
    new = np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))[:rows.shape[1]]
    lead = place[:, np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    return rows[:, new], rows[:, (place != lead).any(axis=0)]


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [[], [], [], [], [], []]
            for doc, key, text in zip(*(part.column(c).to_pylist() for c in ("doc", "key", "text"))):
                anchor, segment, at, n = segments((text or "").encode("utf-8", "surrogatepass"), length, gram)
                for column, values in zip(found, (anchor, segment, np.full(len(at), doc, np.int64), at, n, np.full(len(at), key, np.int64))):
                    column.append(values)
            rows = np.array([np.concatenate(c) for c in found], np.int64)
            first, repeats = split_repeats(rows[:, np.lexsort(rows[[3, 5, 2, 1, 0]])])
            yield _batch(FIRST, first)
            # These need no company: any value spreads them.
            repeats[0] = repeats[2] * 31 + repeats[3]
            yield _batch(REPEAT, repeats)

    return run


def _settle(crowd: int):
    """On rows sorted by anchor, segment, doc, key, at: repeats, and the first places of anchors with several segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = None, None

        def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            first, repeats = split_repeats(rows)
            yield _batch(REPEAT, repeats)
            new = np.flatnonzero(np.append(True, first[0, 1:] != first[0, :-1])[:first.shape[1]])
            sizes = np.diff(np.append(new, first.shape[1])).repeat(np.diff(np.append(new, first.shape[1])))
            yield _batch(FIRST, first[:, (sizes > 1) & (sizes <= crowd)])
            yield _batch(CROWDED, first[:, sizes > crowd])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.array([batch.column(c).to_numpy() for c in COLUMNS[1:batch.num_columns]], np.int64)
            done = batch.column("kind").to_numpy() == REPEAT
            if done.any():
                yield _batch(REPEAT, rows[:, done])
            held = rows[:, ~done] if held is None else np.concatenate([held, rows[:, ~done]], axis=1)
            if not held.shape[1]:
                continue
            last = np.searchsorted(held[0], held[0, -1])
            ready, held = held[:, :last], held[:, last:]
            if ready.shape[1] and crowded == ready[0, 0]:
                mine = np.searchsorted(ready[0], crowded, "right")
                first, repeats = split_repeats(ready[:, :mine])
                yield _batch(REPEAT, repeats)
                yield _batch(CROWDED, first)
                ready = ready[:, mine:]
            if ready.shape[1]:
                yield from settle(ready)
            if held.shape[1] > max(HELD, 2 * crowd):
                # Keep the last segment's first row: later rows of that segment repeat it.
                first, repeats = split_repeats(held)
                yield _batch(REPEAT, repeats)
                if crowded == held[0, 0] or first.shape[1] > crowd:
                    crowded = held[0, 0]
                    yield _batch(CROWDED, first[:, :-1])
                    held = first[:, -1:]
                else:
                    held = first
        if held is not None and held.shape[1]:
            if crowded == held[0, 0]:
                first, repeats = split_repeats(held)
                yield _batch(REPEAT, repeats)
                yield _batch(CROWDED, first)
            else:
                yield from settle(held)

    return run


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (uint8) in order of their first ``depth`` bytes, by two-stage sorting.

    Stage one sorts the suffixes that are smaller than their successors. Stage two scans the buckets of first bytes in
    ascending order: the predecessor of each suffix met, if it is not smaller than its successor, is the next of its own
    bucket's front part. Runs of one byte feed the bucket that is being scanned, a step of the run at a time."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    padded = np.append(text, np.zeros(depth + 1, np.uint8))
    # smaller[i]: suffix i < suffix i + 1; decided by the end of the run of bytes that begins at i.
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    ends = change[np.searchsorted(change, np.arange(n))]
    smaller = (ends < n - 1) & (text[np.minimum(ends + 1, n - 1)] > text)
    direct = np.flatnonzero(smaller)
    views = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(views).view(f"S{depth}").ravel(), kind="stable")]
    behind = [direct[a:b] for a, b in zip(*(np.searchsorted(text[direct], np.arange(256), side) for side in ("left", "right")))]
    front: list[list[np.ndarray]] = [[] for _ in range(256)]
    # The last suffix is larger than the empty one behind it, so it leads its bucket.
    front[text[n - 1]].append(np.array([n - 1]))
    out = []

    def induce(met: np.ndarray, byte: int) -> np.ndarray:
        """Puts the predecessors of ``met`` into their buckets; returns those that belong to the one being scanned."""
        before = met[met > 0] - 1
        before = before[~smaller[before]]
        first = text[before]
        own, others = before[first == byte], before[first != byte]
        order = np.argsort(text[others], kind="stable")
        others = others[order]
        values, starts = np.unique(text[others], return_index=True)
        for value, part in zip(values.tolist(), np.split(others, starts[1:])):
            front[value].append(part)
        return own

    for byte in range(256):
        queue = front[byte]
        for part in queue:
            own = induce(part, byte)
            out.append(part)
            if len(own):
                queue.append(own)
        if len(behind[byte]):
            induce(behind[byte], byte)
            out.append(behind[byte])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, at most ``depth``; 0 for the first."""
    padded = np.append(text, np.zeros(depth, np.uint8))
    view = np.lib.stride_tricks.sliding_window_view(padded, depth)
    out = np.zeros(len(order), np.int64)
    for low in range(1, len(order), 1 << 16):
        part = np.arange(low, min(low + (1 << 16), len(order)))
        differ = view[order[part]] != view[order[part - 1]]
        out[part] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    return out


def repeated_windows(
    parts: list[bytes], docs: list[int], keys: list[int], places: list[int], length: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, key, first window, number of windows) of the runs of windows of ``parts`` that equal an earlier one."""
    sizes = np.array([len(p) for p in parts])
    # A byte between the parts keeps windows apart: only those inside a part are looked at.
    text = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    part_of = np.repeat(np.arange(len(parts)), sizes + 1)
    inside = np.arange(len(text)) - starts[part_of]
    order = suffix_array(text, length)
    order = order[inside[order] + length <= sizes[part_of[order]]]
    new = common_prefixes(text, order, length) < length
    if len(new):
        new[0] = True
    group = np.cumsum(new) - 1
    docs, keys, places = (np.array(c, np.int64) for c in (docs, keys, places))
    doc, key, at = docs[part_of[order]], keys[part_of[order]], places[part_of[order]] + inside[order]
    ranked = np.lexsort((at, key, doc, group))
    doc, key, at, group, order = doc[ranked], key[ranked], at[ranked], group[ranked], order[ranked]
    lead = np.flatnonzero(np.append(True, group[1:] != group[:-1])[:len(group)])
    lead = lead[group] if len(lead) else lead
    repeat = (doc != doc[lead]) | (key != key[lead]) | (at != at[lead])
    at_text = np.sort(order[repeat])
    run = np.flatnonzero(np.append(True, np.diff(at_text) != 1)[:len(at_text)])
    begin = at_text[run]
    part = part_of[begin]
    return docs[part], keys[part], places[part] + inside[begin], np.diff(np.append(run, len(at_text)))


def _arrays(length: int):
    """On rows sorted by anchor: suffix arrays over whole anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, docs, keys, places = [], [], [], []
        size, last = 0, None

        def work() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, repeated_windows(parts, docs, keys, places, length))], ["doc", "key", "at", "n"])

        for batch in batches:
            for anchor, doc, key, at, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "key", "at", "raw"))):
                if size >= ARRAY_BYTES and anchor != last:
                    yield work()
                    parts, docs, keys, places, size = [], [], [], [], 0
                parts.append(raw)
                docs.append(doc)
                keys.append(key)
                places.append(at)
                size, last = size + len(raw), anchor
        if parts:
            yield work()

    return run


def _fetch(length: int):
    """Bytes of the segments asked for; of crowded anchors, a digest of each window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        names = ["anchor", "doc", "key", "at", "raw", "high", "low"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        for part in slices(batches, "packed"):
            out: list[list] = [[] for _ in names]
            for doc, key, packed, asked in zip(*(part.column(c).to_pylist() for c in ("doc", "key", "packed", "asked"))):
                text = unpack.decompress(packed)
                for ask in asked:
                    at, end = ask["at"], ask["at"] + ask["n"] - 1 + length
                    if ask["kind"] == FIRST:
                        rows = [(ask["anchor"], doc, key, at, text[at:end], None, None)]
                    else:
                        digests = [xxhash.xxh3_128_intdigest(text[i:i + length]) for i in range(at, at + ask["n"])]
                        rows = [(None, doc, key, i, None, (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)) for i, d in enumerate(digests, at)]
                    for row in rows:
                        for column, value in zip(out, row):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return run


def _pack(kept: list[str]):
    """Texts as compressed bytes: they cross the network twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for part in slices(batches, "text"):
            packed = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(packed, pa.binary())], [*kept, "packed"])

    return run


def _remove(length: int, kept: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for part in slices(batches, "packed"):
            out: list[list] = [[], [], [], []]
            for packed, cuts in zip(part.column("packed").to_pylist(), part.column("cuts").to_pylist()):
                text = unpack.decompress(packed)
                edges = np.zeros(len(text) + 1, np.int64)
                for cut in cuts or ():
                    edges[cut["at"]] += 1
                    edges[cut["at"] + cut["n"] - 1 + length] -= 1
                gone = np.cumsum(edges[:-1]) > 0
                rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(gone & ~np.append(False, gone[:-1]))) if len(gone) else 0
                last = rest.decode("utf-8", "ignore") if with_text else hashlib.sha256(rest).hexdigest()
                for column, value in zip(out, (len(text), int(gone.sum()), spans, last)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())],
                [*kept, "n_bytes", "n_removed", "n_spans", "kept_text" if with_text else "kept_sha256"])

    return run


def repeats(docs: DataFrame, folder: str, length: int, gram: int, crowd: int) -> DataFrame:
    """``doc``, ``key``, ``at``, ``n``: runs of repeated windows of ``docs`` (``doc``, ``key``, ``text``)."""
    rows = docs.mapInArrow(_anchors(length, gram), SCHEMA)
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "segment", "doc", "key", "at")
    settled = stage(dealt.mapInArrow(_settle(crowd), SCHEMA), folder, "settled")
    asked = settled.where(F.col("kind") != REPEAT).groupBy("doc", "key").agg(F.collect_list(F.struct("kind", "anchor", "at", "n")).alias("asked"))
    packed = docs.mapInArrow(_pack(["doc", "key"]), "doc long, key long, packed binary")
    # Equal rows ask the same and give equal answers.
    fetched = packed.join(asked.hint("shuffle_hash"), ["doc", "key"]).select("doc", "key", "packed", "asked").mapInArrow(
        _fetch(length), "anchor long, doc long, key long, at long, raw binary, high long, low long")
    fetched = stage(fetched, folder, "fetched")
    grouped = fetched.where("raw IS NOT NULL").select("anchor", "doc", "key", "at", "raw").repartition("anchor").sortWithinPartitions("anchor")
    arrays = grouped.mapInArrow(_arrays(length), "doc long, key long, at long, n long")
    windows = fetched.where("raw IS NULL").select("high", "low", "doc", "key", "at")
    first = windows.groupBy("high", "low").agg(F.min(F.struct("doc", "key", "at")).alias("first"))
    crowded = windows.join(first, ["high", "low"]).where(F.struct("doc", "key", "at") != F.col("first")).select(
        "doc", "key", "at", F.lit(1).cast("long").alias("n"))
    return settled.where(F.col("kind") == REPEAT).select("doc", "key", "at", "n").union(arrays).union(crowded)


def without_repeats(
    docs: DataFrame, keep: list[str], with_text: bool = False, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Columns ``keep`` of every row with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``, or ``kept_text``
    (remaining bytes; a character cut in part is dropped) of its text without repeats.

    A null text is empty; a text shorter than ``length`` has no repeats. A null id stands before all others. Rows equal
    in id and text are one document; different texts with one id are documents of their own, in the order of a digest.
    ``keep`` names neither the text nor ``doc``, ``__key``, ``packed``, ``cuts``; columns beside it are not read.
    """
    folder = run_folder(docs.sparkSession, "repeats")
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc")
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    source = docs.select(doc, key.alias("key"), F.col(text).alias("text"))
    cuts = repeats(source, folder, length, gram, crowd).groupBy("doc", F.col("key").alias("__key")).agg(
        F.collect_list(F.struct("at", "n")).alias("cuts"))
    kept = docs.select(doc, key.alias("__key"), *keep, F.col(text).alias("text"))
    names = ["doc", "__key", *keep]
    fields = kept.select(*names).schema
    packed = kept.mapInArrow(_pack(names), fields.add("packed", "binary"))
    out = docs.select(*keep).withColumns({
        "n_bytes": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"),
        "kept_text" if with_text else "kept_sha256": F.lit("")}).schema
    return packed.join(cuts.hint("shuffle_hash"), ["doc", "__key"], "left").select(*keep, "packed", "cuts").mapInArrow(_remove(length, keep, with_text), out)


@query()
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated strings of 100 bytes."""
    return without_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
