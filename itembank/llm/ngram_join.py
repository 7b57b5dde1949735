"""An exact Jaccard join of documents by their word n-grams, over prefixes of token combinations.

A document is its set of word shingles, the tokens. Tokens have one order for all documents, rare ones first: by how much of
the corpus a sketch of fixed size counts for them, then by digest. Of two sets that are similar enough, one lacks at most ``errors`` tokens of
the other, so they share tokens in the first ``errors + 1`` of their orders (Chaudhuri et al., 2006). Where these are tokens that many documents have,
sharing one says little; so tokens are put into classes by the number of prefixes that hold them, and a token of class k counts only in
combination with k - 1 others of its class (Wang et al., 2016):

* the tokens of class k are dealt into small groups by their digest; all k-combinations within a group are indexed, for k = 1 the token itself;
* a prefix is extended until the sum over its groups of (tokens - k + 1), none below 0, exceeds ``errors``: a partner that shares no
  combination would have to lack that many.

Groups are small because their number follows from the size class of the set. Two sets meet in the size class of the smaller one, so a
set is indexed under each class that a partner may have, two at most.

A token that no other prefix holds is in no partner whose prefix reaches as far. So a set with more than ``errors`` such tokens has partners only
among sets that have fewer and whose prefix ends before its own; others are never compared to it, which spares texts that share a passage.

In every bucket of a combination one set, chosen by a digest, is compared to the others: a row per member. Links make components, and buckets that
still hold several are searched completely, in blocks, between components only. A pair's prefixes bound its similarity; pairs that pass are verified on the
full sets. Nothing is lost: digests of 64 bits stand for tokens, as in the verification.
"""
from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.llm.common import query, run_folder, slices, stage, table
from itembank.llm.setsketch import _GOLDEN, _mix, components, similar
from itembank.operators.skew import attach_per_key

#: The sketch: counters in all (32 MB a task while it counts, 4 MB of levels afterwards), and in one slice of it.
COUNTERS, SLICE = 1 << 22, 1 << 12
#: Levels of the order start at these multiples of a count well above that of a counter with rare tokens alone (``common``).
LEVELS = (1, 8, 64)
#: Tokens in so many prefixes are of class 2 and 3; tokens of a group, about.
CLASSES = (16, 1024)
GROUP = 6
#: Members and bytes of one block of a bucket.
MEMBERS, BLOCK_BYTES = 256, 8 << 20
#: Bytes of text whose words are cut and hashed at once; a longer word gets its digest by itself.
PIECE_BYTES, LONG_WORD = 1 << 20, 64
#: Pairs of a member and a block that are verified first.
BEST = 8
#: Bits that tell which keys are asked for (2 MB, whatever the size of the input).
MARKS = 1 << 24
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: The first k of eight bytes, little-endian.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of texts that lie in ``data`` one after the other, and the number of words before each bound."""
    word = ~_SPACE[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begin[inner], end[inner - 1] = word[inner], word[inner - 1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    size, padded = stop - start, np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data), "<u8", padded, strides=(1,))
    codes = size.astype(np.uint64)
    live = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        live = live[size[live] > at]
        part = eight[start[live] + at] & _FIRST[np.minimum(size[live] - at, 8)]
        codes[live] = _mix(codes[live] * _GOLDEN + part)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        codes[i] = xxhash.xxh3_64_intdigest(padded[start[i]:stop[i]].tobytes())
    return codes, np.searchsorted(start, bounds)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Digests of the distinct word shingles of every text, sorted. Words are runs of bytes other than white space of ASCII; A-Z are
    lower-cased; fewer than ``width`` words are one shingle, no words (or no text) none. All words of ``texts`` are hashed together."""
    held = pa.compute.fill_null(texts, "").cast(pa.large_binary())
    if not len(held):
        return []
    bounds = np.frombuffer(held.buffers()[1], np.int64)[held.offset:held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    codes, first = _words(data, bounds - bounds[0])
    counts, total = np.diff(first), len(codes)
    made = np.full(total, width, np.uint64)
    whole = max(0, total - width + 1)
    for i in range(width):
        made[:whole] = _mix(made[:whole] * _GOLDEN + codes[i:i + whole])
    # A shingle ends in its text, or is the whole of a text of fewer words.
    kept = np.arange(total) + width <= np.repeat(first[1:], counts)
    for n in range(1, width):
        at = first[:-1][counts == n]
        value = np.full(len(at), n, np.uint64)
        for i in range(n):
            value = _mix(value * _GOLDEN + codes[at + i])
        made[at], kept[at] = value, True
    flat = made[kept]
    cuts = np.concatenate([[0], np.cumsum(np.where(counts > 0, np.maximum(counts - width + 1, 1), 0))]).tolist()
    out = []
    for i, j in zip(cuts[:-1], cuts[1:]):
        own = flat[i:j]
        own.sort()
        differs = own[1:] != own[:-1]
        out.append(own if differs.all() else own[np.concatenate([[True], differs])])
    return out


def errors(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` may have and a similar set may lack."""
    return n - -(-percent * n // 100)


def least_size(percent: int) -> int:
    """A smaller set has no partner but equal ones."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def size_classes(n: int, percent: int) -> range:
    """Size classes that ``n`` is indexed under: those of all smaller sets of a pair that it may be in."""
    return range((-(-percent * n // 100)).bit_length() - 1, n.bit_length())


def groups(size_class: int, percent: int) -> int:
    """Groups that a class of tokens is dealt into, for sets of that size class; 0 if its smallest sets are too small for
    combinations, so that all tokens count alone."""
    count = max(1, errors(int(1.4 * 2 ** size_class), percent) // GROUP)
    smallest = 1 << size_class
    return count if errors(smallest, percent) + 1 + 3 * count <= smallest else 0


def prefix_size(n: int, percent: int) -> int:
    """Tokens that suffice for any classes: each group may waste one token in class 2 and two in class 3."""
    return min(n, errors(n, percent) + 1 + 3 * max(groups(c, percent) for c in size_classes(n, percent)))


def combinations(tokens: np.ndarray, counts: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Digests of the combinations that a set of ``n`` is indexed under. ``tokens``: its prefix in order; ``counts``: prefixes that
    hold each token (those that are alone, 1)."""
    needed = errors(n, percent) + 1
    out = []
    for size_class in size_classes(n, percent):
        dealt = groups(size_class, percent)
        kind = 1 + (counts >= CLASSES[0]).astype(int) + (counts >= CLASSES[1]) if dealt else np.ones(len(tokens), int)
        group = np.where(kind > 1, kind * (dealt + 1) + (_mixed(tokens) % np.uint64(max(1, dealt))).astype(int), 0)
        # A token counts if its group already holds k - 1 tokens.
        seen: dict[int, int] = {}
        counted = 0
        for cut, (g, k) in enumerate(zip(group.tolist(), kind.tolist()), 1):
            seen[g] = seen.get(g, 0) + 1
            counted += k == 1 or seen[g] >= k
            if counted == needed:
                break
        group, kind, held = group[:cut], kind[:cut], tokens[:cut]
        out.append(_mixed(held[(kind == 1) & (counts[:cut] > 1)] * _MIX + np.uint64(1)))
        for g in seen.keys() - {0}:
            own = held[group == g]
            k = int(kind[group == g][0])
            picked = np.array(list(itertools.combinations(range(len(own)), k)), np.int64).reshape(-1, k)
            made = np.full(len(picked), np.uint64(k * 64 + size_class), np.uint64)
            for column in picked.T:
                made = _mixed(made * _MIX + own[column])
            out.append(made)
    return np.unique(np.concatenate(out))


def may_be_similar(x: np.ndarray, n_x: int, y: np.ndarray, n_y: int, percent: int) -> bool:
    """Whether sets of ``n_x`` and ``n_y`` tokens that begin with ``x`` and ``y`` can be similar enough."""
    ends = [s[-1] for s, n in ((x, n_x), (y, n_y)) if len(s) < n]
    a, b = len(x), len(y)
    if ends:
        a, b = (int(np.searchsorted(s, min(ends), "right")) for s in (x, y))
    # Both sets are known up to the earlier end; beyond it they could share everything.
    most = len(np.intersect1d(x[:a], y[:b], assume_unique=True)) + min(n_x - a, n_y - b)
    return (100 + percent) * most >= percent * (n_x + n_y)


def common(mean: float) -> float:
    """A counter of rare tokens alone, ``mean`` of them on average, stays below this (six deviations)."""
    return mean + 6 * mean ** 0.5 + 8


def _look(width: int):
    """Per document: ``n`` and a digest of its set. At the task's end, its counts of the sketch, in slices."""
    names = ["doc_id", "n", "digest", "slice", "counts"]

    def rows(doc_ids, sizes, digests, numbers, counts) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((doc_ids, sizes, digests, numbers, counts), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)
        for part in slices(batches, "text", PIECE_BYTES):
            made = shingle_sets(part.column("text"), width)
            np.add.at(counters, (np.concatenate(made) & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            sizes = [len(elements) for elements in made]
            digests = [xxhash.xxh3_128_digest(elements.tobytes()) if len(elements) else None for elements in made]
            none = [None] * len(sizes)
            yield rows(part.column("doc_id").to_pylist(), sizes, digests, none, none)
        cut = [(i, counters[i * SLICE:(i + 1) * SLICE]) for i in range(COUNTERS // SLICE)]
        # As many bytes a counter as the slice's largest one needs.
        held = [(i, c.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if c.max() <= np.iinfo(t).max)).tobytes()) for i, c in cut if c.any()]
        if held:
            none = [None] * len(held)
            yield rows(none, none, none, [i for i, _ in held], [c for _, c in held])

    return run


def _levels(mean: float):
    """Counts of each slice, summed as they come, as levels of the order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                held = sums.setdefault(number, np.zeros(SLICE, np.int64))
                held += np.frombuffer(counts, f"<u{len(counts) // SLICE}")
        level = [np.searchsorted([m * common(mean) for m in LEVELS], s, "right").astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(level, pa.binary())], ["slice", "level"])

    return run


def ahead(order: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` tokens in order, and the rare ones after them with the same leading 32 bits as the last: the bits tell where
    a prefix ends."""
    if size >= len(order):
        return order
    parted = np.partition(order, size - 1)
    first, rest = parted[:size], parted[size:]
    return np.concatenate([first, rest[rest >> np.uint64(32) == parted[size - 1] >> np.uint64(32)]])


def _prefixes(width: int, percent: int, packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(zlib.decompress(packed), np.uint8)
        least = least_size(percent)
        for part in slices(batches, "text", PIECE_BYTES):
            made: list[list] = [[], [], [], []]
            for doc_id, elements in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text"), width)):
                if len(elements) >= least:
                    high = level[(elements & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
                    order, size = high << np.uint64(62) | elements >> np.uint64(2), prefix_size(len(elements), percent)
                    first = np.sort(ahead(order, size))
                    for column, value in zip(made, (doc_id, len(elements), xxhash.xxh3_128_digest(elements.tobytes()), first.astype("<u8").tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["least", "n", "digest", "prefix"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for batch in batches for p in slices([batch], "prefix")):
        prefixes = part.column("prefix").to_pylist()
        nodes = np.repeat(part.column("node").to_numpy(), [len(p) // 8 for p in prefixes])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.frombuffer(b"".join(prefixes), "<i8"))], ["node", "token"])


def _indexed(percent: int):
    """``node`` and ``bucket`` of every combination, from prefixes and the counts of those tokens that several prefixes hold, and
    ``near``: whether its lone tokens are few enough for partners whose prefix reaches as far; ``last``: where its own ends."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices([batch], "prefix")):
            nodes, sizes, buckets, near, last = [], [], [], [], []
            for node, n, prefix, known, counts in zip(*(part.column(c).to_pylist() for c in ("node", "n", "prefix", "tokens", "counts"))):
                tokens = np.frombuffer(prefix, "<u8")
                count = np.ones(len(tokens), np.int64)
                count[np.searchsorted(tokens, np.array(known, np.int64).view(np.uint64))] = counts
                made = combinations(tokens, count, n, percent)
                nodes.append(np.full(len(made), node))
                sizes.append(np.full(len(made), n))
                buckets.append(made)
                near.append(np.full(len(made), (count == 1).sum() <= errors(n, percent)))
                last.append(np.full(len(made), int(tokens[-1]) if len(tokens) < n else np.iinfo(np.uint64).max, np.uint64))
            if nodes:
                columns = [np.concatenate(nodes), np.concatenate(sizes), np.concatenate(buckets).view(np.int64), np.concatenate(near), (np.concatenate(last) >> np.uint64(1)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "n", "bucket", "near", "last"])

    return run


def _plausible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [may_be_similar(np.frombuffer(x, "<u8"), n_x, np.frombuffer(y, "<u8"), n_y, percent)
                    for x, n_x, y, n_y in zip(*(batch.column(c).to_pylist() for c in ("prefix_a", "n_a", "prefix_b", "n_b")))]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return run


def _sets(width: int):
    """``digest`` and ``set`` of every text that has shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PIECE_BYTES):
            made = [m.tobytes() for m in shingle_sets(part.column("text"), width) if len(m)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(m) for m in made], pa.binary()), pa.array(made, pa.binary())], ["digest", "set"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices([batch], "set_a")):
            linked = [similar(*(np.frombuffer(s.as_buffer(), "<u8") for s in pair), percent) for pair in zip(part.column("set_a"), part.column("set_b"))]
            yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _pairs(percent: int):
    """All pairs of a small bucket that need be compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[int]] = [[], []]
            for members in batch.column("members").to_pylist():
                told = sorted((m["node"], m["n"], m["near"], m["last"]) for m in members)
                for (a, n_a, near_a, last_a), (b, n_b, near_b, last_b) in itertools.combinations(told, 2):
                    if (near_a or last_a > last_b) and (near_b or last_b > last_a) and 100 * min(n_a, n_b) >= percent * max(n_a, n_b):
                        found[0].append(a)
                        found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["a", "b"])

    return run


def most_shared(left: list[np.ndarray], n_left: np.ndarray, right: list[np.ndarray], n_right: np.ndarray) -> np.ndarray:
    """The most tokens that each set on the left can share with each on the right, given the beginnings of all (``may_be_similar``), or
    the leading bits of these: tokens that agree in them count as shared. No set goes on with the bits of its beginning's end (``ahead``)."""
    most = np.iinfo(left[0].dtype).max
    tokens = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def held(sets: list[np.ndarray]) -> np.ndarray:
        row, flat = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        column = np.minimum(np.searchsorted(tokens, flat), max(len(tokens) - 1, 0))
        hit = tokens[column] == flat if len(tokens) else np.zeros(len(flat), bool)
        out = np.zeros((len(sets), len(tokens)), np.float32)
        out[row[hit], column[hit]] = 1
        return out

    ends = [np.array([s[-1] if len(s) < n else most for s, n in zip(sets, sizes)], left[0].dtype) for sets, sizes in ((left, n_left), (right, n_right))]
    known_left = np.array([np.searchsorted(s, np.minimum(ends[1], end), "right") for s, end in zip(left, ends[0])])
    known_right = np.array([np.searchsorted(s, np.minimum(ends[0], end), "right") for s, end in zip(right, ends[1])]).T
    rest = np.minimum(n_left[:, None] - known_left, n_right[None, :] - known_right)
    # Different tokens of one set may agree in the leading bits.
    ties_left, ties_right = (np.array([int((s[1:] == s[:-1]).sum()) for s in sets]) for sets in (left, right))
    return (held(left) @ held(right).T).astype(np.int64) + rest + np.minimum(ties_left[:, None], ties_right)


def _marked(packed: bytes, then):
    """``then`` of the rows whose ``slot`` is marked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(zlib.decompress(packed), np.uint8)

        def kept() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = batch.column("slot").to_numpy()
                yield batch.filter(pa.array(marks[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1, pa.bool_()))

        yield from then(kept())

    return run


def marked(rows: DataFrame, key: str, wanted: DataFrame, then, schema: str) -> DataFrame:
    """``then`` of those of ``rows`` whose ``key`` is in ``wanted``, and of the few others whose digest of MARKS values is: what a join with
    ``wanted`` drops need not be shuffled for it."""
    slot = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(MARKS))
    told = wanted.select((slot + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    marks = bytearray(MARKS // 8)
    for r in told.collect():
        size = len(r["bits"])
        marks[(r["part"] - 1) * size:r["part"] * size] = r["bits"]
    return rows.withColumn("slot", slot).mapInArrow(_marked(zlib.compress(bytes(marks)), then), schema)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes by the leading 32 bits of their tokens, which keep the order."""
    for batch in batches:
        short = [(np.frombuffer(p, "<u8") >> np.uint64(32)).astype("<u4").tobytes() for p in batch.column("prefix").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(short, pa.binary())], ["node", "prefix"])


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(offsets[:-1], offsets[1:])]


def _across(percent: int, best: int | None):
    """Pairs of two blocks of a bucket, of different components, that may be similar: all, or the ``best`` of each member outside
    the largest component; then also the ``bucket``, if a member has others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column("odd")[i].values, batch.column("other")[i].values
                (a, comp_a, n_a, near_a, last_a), (b, comp_b, n_b, near_b, last_b) = (
                    [s.field(c).to_numpy(zero_copy_only=False) for c in ("node", "comp", "n", "near", "last")] for s in (left, right))
                both_odd = right.field("is_odd").to_numpy(zero_copy_only=False)
                first, second = ([np.frombuffer(p, "<u4") for p in s.field("prefix").to_pylist()] for s in (left, right))
                most = most_shared(first, n_a, second, n_b)
                both = n_a[:, None] + n_b
                # Two that are both outside the largest component meet twice.
                ahead = last_a[:, None] - last_b
                fits = (near_a[:, None] | (ahead > 0)) & (near_b | (ahead < 0)) & ((100 + percent) * most >= percent * both)
                fits &= (comp_a[:, None] != comp_b) & ~(both_odd & (b < a[:, None]))
                # Members meet in every large bucket that they share; the pair is told in the first of them. The lists hold the earlier ones.
                x, y = np.nonzero(fits)
                if len(x):
                    mine, theirs = (_lists(s.field("buckets")) for s in (left, right))
                    earlier = np.intersect1d(np.concatenate(mine), np.concatenate(theirs))
                    if len(earlier):
                        first_m, first_t = (np.array([np.isin(earlier, v, assume_unique=True) for v in lists]) for lists in (mine, theirs))
                        fits[x, y] = ~(first_m[x] & first_t[y]).any(axis=1)
                cut = best is not None and bool((fits.sum(axis=1) > best).any())
                if cut:
                    likeness = np.where(fits, most / both, -1)
                    rank = np.argsort(np.argsort(-likeness, axis=1, kind="stable"), axis=1)
                    fits &= rank < best
                x, y = np.nonzero(fits)
                last_row = [None] * cut
                told = [[*np.minimum(a[x], b[y]).tolist(), *last_row], [*np.maximum(a[x], b[y]).tolist(), *last_row],
                        [None] * len(x) + batch.column("bucket").slice(i, int(cut)).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in told], ["a", "b", "bucket"])

    return run


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row.

    Two documents link if 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles; ``component_id`` is the least id
    that links reach. Texts that are null or without words have no shingles and are linked with nothing: their component is their id.
    Rows that share an id are one document, linked if any of its texts is. A null id is linked with nothing and has no component.
    An empty table gives no row. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = run_folder(spark, "ngrams")
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    looked = stage(given.mapInArrow(_look(width), "doc_id long, n long, digest binary, slice int, counts binary"), folder, "looked")
    rows = looked.where("slice IS NULL").select("doc_id", "n", "digest")
    real = rows.where("n > 0 AND doc_id IS NOT NULL")
    total = rows.agg(F.sum("n")).first()[0] or 0

    # COUNTERS levels, one byte each, whatever the size of the input.
    level = np.zeros(COUNTERS, np.uint8)
    counted = looked.where("slice IS NOT NULL").select("slice", "counts").repartition("slice")
    for r in counted.mapInArrow(_levels(total / COUNTERS), "slice int, level binary").collect():
        level[r["slice"] * SLICE:(r["slice"] + 1) * SLICE] = np.frombuffer(r["level"], np.uint8)

    by_set = real.groupBy("digest", "n").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = stage(by_set.withColumn("node", F.monotonically_increasing_id()), folder, "classes")
    made = given.where("doc_id IS NOT NULL").mapInArrow(_prefixes(width, percent, zlib.compress(level.tobytes())), "least long, n long, digest binary, prefix binary")
    made = stage(made, folder, "made")
    # Of equal rows with the least id one is enough.
    prefixes = stage(made.join(classes, ["least", "n", "digest"]).select("node", "n", "prefix").dropDuplicates(["node"]), folder, "prefixes")

    tokens = prefixes.select("node", "prefix").mapInArrow(_tokens, "node long, token long")
    several = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    known = tokens.join(several, "token").groupBy("node").agg(F.collect_list("token").alias("tokens"), F.collect_list("count").alias("counts"))
    indexed = stage(prefixes.join(known, "node").mapInArrow(_indexed(percent), "node long, n long, bucket long, near boolean, last long"), folder, "indexed")

    # Buckets of the same members say the same; one of them stays.
    digest = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    lead = F.min(F.struct((~F.col("near")).alias("far"), F.xxhash64("node").alias("order"), F.col("node").alias("node"), F.col("n").alias("n")))
    reach = indexed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.when(F.col("near"), F.col("last"))).alias("reach")).where("size > 1 AND reach IS NOT NULL")
    worth = stage(indexed.join(reach.select("bucket", "reach"), "bucket").where("near OR last > reach").drop("reach"), folder, "worth")
    sizes = worth.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), digest(1).alias("x"), digest(2).alias("y"), lead.alias("lead")).where("size > 1")
    buckets = sizes.groupBy("size", "x", "y", "lead").agg(F.min("bucket").alias("bucket")).select("bucket", "lead", "size")
    members = stage(worth.join(buckets, "bucket"), folder, "members")

    def of(side: str, frame: DataFrame, *columns: str) -> DataFrame:
        return frame.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Those of ``pairs`` that are linked. Only documents of a pair are read again."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        asked = stage(nodes.join(classes, "node").select("node", F.col("least").alias("doc_id"), "digest"), folder, f"{name}-asked")
        sets = marked(given, "doc_id", asked.select("doc_id"), _sets(width), "digest binary, set binary").dropDuplicates(["digest"])
        sets = stage(sets.join(asked, "digest").select("node", "set"), folder, f"{name}-sets")
        full = pairs.join(of("a", sets, "set"), "a").join(of("b", sets, "set"), "b")
        return stage(full.mapInArrow(_verify(percent), "a long, b long"), folder, name)

    # Tokens of class 1 have small buckets: all their pairs, a bounded number a member. In others a row per member.
    small = members.where(F.col("size") < CLASSES[0]).groupBy("bucket").agg(F.collect_list(F.struct("node", "n", "near", "last")).alias("members"))
    alike = 100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n")
    led = members.where((F.col("size") >= CLASSES[0]) & (F.col("node") != F.col("lead.node")) & alike)
    led = led.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
    pairs = small.select("members").mapInArrow(_pairs(percent), "a long, b long").union(led).distinct()
    both = pairs.join(of("a", prefixes, "prefix", "n"), "a").join(of("b", prefixes, "prefix", "n"), "b")
    links = verified(stage(both.mapInArrow(_plausible(percent), "a long, b long"), folder, "likely"), "links")

    large = members.where(F.col("size") >= CLASSES[0]).select("bucket", "node", "n", "near", "last")
    joined = links
    for name, best in (("near", BEST), ("all", None)):
        # The likeliest pairs first: what they link need not be searched.
        comps = components(joined, folder, f"{name}-comps")
        held = stage(large.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), folder, f"{name}-held")
        per_comp = held.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens"))
        blocks = F.ceil(F.greatest(F.sum("size") / MEMBERS, 4 * F.sum("tokens") / BLOCK_BYTES))
        split = per_comp.groupBy("bucket").agg(F.max(F.struct("size", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("comps"), blocks.alias("blocks")).where("comps > 1")
        place = F.struct("bucket", "blocks", (F.col("comp") != F.col("main")).alias("is_odd"))
        # A member's open buckets, in order; no more than its combinations.
        nodes = held.join(split, "bucket").groupBy("node", "comp", "n", "near", "last").agg(F.array_sort(F.collect_list(place)).alias("places"))
        nodes = stage(nodes, folder, f"{name}-open")
        # A prefix goes to the buckets of its node last, once to each.
        short = marked(prefixes.select("node", "prefix"), "node", nodes.select("node"), _short, "node long, prefix binary")
        placed = nodes.join(short, "node").select("*", F.posexplode("places").alias("at", "place")).withColumn("buckets", F.slice("places.bucket", F.lit(1), F.col("at")))
        member = F.struct("node", "comp", "n", "near", "last", "prefix", "buckets", F.col("place.is_odd").alias("is_odd"))
        whole = placed.select("place.bucket", "place.blocks", F.pmod(F.xxhash64("node"), F.col("place.blocks")).alias("chunk"), member.alias("member"))
        home = stage(whole.groupBy("bucket", "blocks", "chunk").agg(F.collect_list("member").alias("other")), folder, f"{name}-home")
        odd = F.filter("other", lambda m: m["is_odd"])
        within = home.select("bucket", odd.alias("odd"), "other").where(F.size("odd") > 0)
        # In a bucket of several blocks, those outside the largest component visit the others.
        visitors = home.where("blocks > 1").select("bucket", "chunk", "blocks", odd.alias("odd")).where(F.size("odd") > 0)
        visitors = visitors.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("to <> chunk").select("bucket", "to", "odd")
        hosts = home.where("blocks > 1").select("bucket", F.col("chunk").alias("to"), "other")
        met = within.union(visitors.join(hosts, ["bucket", "to"]).select("bucket", "odd", "other"))
        found = stage(met.mapInArrow(_across(percent, best), "a long, b long, bucket long").distinct(), folder, f"{name}-met")
        links = verified(found.where("a IS NOT NULL").select("a", "b"), f"{name}-links")
        joined = comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(links)
        # A bucket where every member told all its pairs is done.
        large = large.join(found.where("bucket IS NOT NULL").select("bucket"), "bucket", "left_semi")

    # Different texts of one id are one document.
    several_sets = real.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    texts_of = real.distinct().join(several_sets, "doc_id", "left_semi").join(classes.select("digest", "n", "node"), ["digest", "n"])
    shared = texts_of.join(texts_of.groupBy("doc_id").agg(F.min("node").alias("first")), "doc_id").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    final = components(joined.union(shared), folder, "final")

    grouped = classes.join(final, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = grouped.join(grouped.groupBy("comp").agg(F.min("least").alias("component")), "comp").select("digest", "n", "copies", "component")
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    out = attach_per_key(rows.where(linked), stage(named, folder, "named"), ["digest", "n"], count="copies", row_id="doc_id").select("doc_id", "n", "component")
    alone = rows.where(~linked).select("doc_id", "n", F.col("doc_id").alias("component"))
    return out.union(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query()
def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by sets of three-word shingles, from 0.9."""
    return jaccard_components(table(spark, sf_dir, "documents"))
