"""A prefix trie over conversations that share their first turns, with the savings of storing each shared turn once.

A turn's id is the first 16 bytes of the SHA-256 of its role and text; equal conversations are one class, with the number
of its members. A class is cut into panels of ``WIDTH`` turns; a panel row holds the ids of its turns and a digest of all
turns before it, so rows stay small however long a conversation is, and all panels are worked on at once.

Rows are sorted by (panel, digest before, turn ids) over the whole table and cut into shards of a bounded number. A shard is a matrix of
turn ids, padded where a row ends. Rows in lexical order share their first d turns over one run of rows, so the columns' change masks,
OR-accumulated from the left, mark where the nodes of each depth start, and ``reduceat`` adds up every depth. Nodes that cross the rim of a shard lie on
the paths of its first or last row: their sums are recombined by a digest of their path and handed back.

What a node needs of its subtree is a sum over its members, so no walk over the depths is needed. The least member of a node
is the least one of all its deeper nodes, too; each class is charged for the nodes that it is the least of, a stretch at the end
of its path. A first pass finds that stretch and whether anything extends the class; the second adds up.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itembank.llm import places
from itembank.llm.common import query, run_folder, stage, table

WIDTH = 64
SHARD_ROWS = 20_000
#: Panels whose digests one window adds up; conversation ids joined in one row.
BUCKET, JOINED = 4096, 50_000
#: A conversation takes up to this many less one turns of the one it starts from, of every FAMILY ids the first.
HEADS, FAMILY = 9, 5
ID_BYTES = 16

PARTIALS = "shard long, depth int, side int, path binary, convs long, least long, leaves long, saved long"
LOOKED = "conv long, own long, end_conv long, leaf long"
NODES = "conv long, depth long, parent long, convs long, leaves long, saved long"


def turn_id(role: Column, text: Column) -> Column:
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(both, 256)), 1, ID_BYTES)


def rebuilt(conversations: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(``conv``, ``len``) of all conversations, and (``conv``, ``at``, ``tid``, ``size``) of their turns after a conversation
    has taken its first turns from the first of its family."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    given = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), turn_id(role, text).alias("tid"),
        F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("salt"))
    placed = places.sorted_rows(stage(given, folder, "given"), ["conv", F.col("turn").asc_nulls_first(), "tid", "salt"], folder, "placed")
    held = stage(places.runs(placed, "conv"), folder, "runs")
    own = held.groupBy("conv").agg(F.max("total").alias("own"))
    base, taken = F.col("conv") - F.col("conv") % FAMILY, (places.crc(F.col("conv")) % HEADS).cast("long")
    of_base = own.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    skip = F.when(F.col("conv") == F.col("base"), 0).otherwise(taken).cast("long")
    convs = stage(
        own.withColumn("base", base).join(of_base, "base", "left").withColumn("skip", skip)
        .withColumn("head", F.least("skip", F.coalesce("base_own", F.lit(0))))
        .select("conv", "base", "skip", "head", (F.col("head") + F.greatest(F.col("own") - F.col("skip"), F.lit(0))).alias("len")), folder, "convs")
    # What a conversation skips and takes goes to its turns by part, so a long conversation is no key of a join.
    about = held.join(convs.select("conv", "skip", "head"), "conv")
    turns = stage(places.placed_rows(placed, about, "conv").select("conv", "pos", "skip", "head", "tid", "size"), folder, "turns")
    tails = turns.where("pos >= skip").select("conv", (F.col("pos") - F.col("skip") + F.col("head")).alias("at"), "tid", "size")
    first = turns.where((F.col("pos") < HEADS - 1) & (F.col("conv") % FAMILY == 0)).select(F.col("conv").alias("base"), "pos", "tid", "size")
    heads = convs.where("head > 0").select("conv", "base", F.col("head").alias("upto")).join(first, "base").where("pos < upto")
    return convs.select("conv", "len"), tails.union(heads.select("conv", F.col("pos").alias("at"), "tid", "size"))


def _panels(turns: DataFrame, folder: str) -> DataFrame:
    """``conv``, ``panel``, ``tids`` (ids joined), ``sizes``, a digest of the panel (``hi``, ``lo``), one of the panels before it (``pre_hi``,
    ``pre_lo``), and ``rest``, the bytes after it. Digests are joined by exclusive or, each made with its panel's number, so they
    add up in any order and in parts."""
    whole = turns.groupBy("conv", F.floor(F.col("at") / WIDTH).alias("panel")).agg(F.array_sort(F.collect_list(F.struct("at", "tid", "size"))).alias("t"))
    joined = F.aggregate("t", F.lit(b""), lambda a, x: F.concat(a, x["tid"]))
    hexed = F.sha2(F.concat(F.col("panel").cast("string").cast("binary"), F.lit(b":"), F.col("tids")), 256)
    number = lambda a, b: F.conv(F.substring("hex", a, b), 16, 10).cast("long")
    panels = stage(
        whole.select("conv", "panel", joined.alias("tids"), F.col("t.size").alias("sizes")).withColumn("hex", hexed)
        .select("conv", "panel", "tids", "sizes", number(1, 15).alias("hi"), number(16, 15).alias("lo"),
                F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes"), F.floor(F.col("panel") / BUCKET).alias("bucket")), folder, "panels")
    sums = panels.groupBy("conv", "bucket").agg(F.bit_xor("hi").alias("b_hi"), F.bit_xor("lo").alias("b_lo"), F.sum("bytes").alias("b_bytes"))
    outer = W.partitionBy("conv").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    earlier = sums.select("conv", "bucket", F.bit_xor("b_hi").over(outer).alias("o_hi"), F.bit_xor("b_lo").over(outer).alias("o_lo"),
                          F.sum("b_bytes").over(outer).alias("o_bytes"), F.sum("b_bytes").over(W.partitionBy("conv")).alias("all_bytes"))
    inner = W.partitionBy("conv", "bucket").orderBy("panel").rowsBetween(W.unboundedPreceding, -1)
    local = panels.withColumns({"i_hi": F.bit_xor("hi").over(inner), "i_lo": F.bit_xor("lo").over(inner), "i_bytes": F.sum("bytes").over(inner)})
    zero = lambda c: F.coalesce(c, F.lit(0))
    return local.join(earlier, ["conv", "bucket"]).select(
        "conv", "panel", "tids", "sizes", "hi", "lo", zero("i_hi").bitwiseXOR(zero("o_hi")).alias("pre_hi"), zero("i_lo").bitwiseXOR(zero("o_lo")).alias("pre_lo"),
        (F.col("all_bytes") - zero("i_bytes") - zero("o_bytes") - F.col("bytes")).alias("rest"))


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by class and id: runs of at most JOINED ids of one class, joined by commas."""
    names = ["hi", "lo", "len", "first", "n", "ids"]
    types = [pa.int64()] * 5 + [pa.string()]
    current, ids = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*current, ids[0], len(ids), ",".join(map(str, ids))], types)], names)

    for batch in batches:
        for *key, conv in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "len", "conv"))):
            if key != current or len(ids) == JOINED:
                if ids:
                    yield row()
                current, ids = key, []
            ids.append(conv)
    if ids:
        yield row()


def _digest_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class from its runs in order; the digest takes the runs as they come, whatever their number."""
    names = ["hi", "lo", "len", "conv", "n", "ends"]
    current, made, first, n, digest = None, [], None, 0, None

    def close() -> None:
        made.append((*current, first, n, digest.hexdigest()))

    for batch in batches:
        for *key, at, held, ids in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "len", "first", "n", "ids"))):
            if key != current:
                if current:
                    close()
                current, first, n, digest = key, at, 0, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
            n += held
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names)
            made.clear()
    if current:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names)


def _classes(convs: DataFrame, panels: DataFrame, folder: str) -> DataFrame:
    """Equal conversations as one: its least member ``conv``, the number ``n``, ``len``, and ``ends``, the digest of its members."""
    whole = panels.groupBy("conv").agg(F.bit_xor("hi").alias("hi"), F.bit_xor("lo").alias("lo"))
    members = stage(convs.join(whole, "conv", "left").select("conv", "len", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hi", "lo")]), folder, "members")
    order = ["hi", "lo", "len", "conv"]
    joined = members.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_join_ids, "hi long, lo long, len long, first long, n long, ids string")
    gathered = joined.repartition("hi", "lo", "len").sortWithinPartitions("hi", "lo", "len", "first")
    return stage(gathered.mapInArrow(_digest_ids, "hi long, lo long, len long, conv long, n long, ends string"), folder, "classes")


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two rows have in common at their start."""
    n = min(len(a), len(b)) // ID_BYTES
    x, y = (np.frombuffer(s, ">u8", 2 * n).reshape(n, 2) for s in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else n


class Matrix:
    """Rows of a shard in lexical order, as a padded matrix of turn ids, and where the nodes of each depth start."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        number = {c: rows.column(c).to_numpy() for c in ("panel", "pre_hi", "pre_lo", "conv", "n", "len", "rest", "own", "leaf")}
        tids = rows.column("tids").to_pylist()
        count = np.array([len(t) // ID_BYTES for t in tids])
        width, there = int(count.max()), np.arange(count.max()) < count[:, None]
        flat = np.frombuffer(b"".join(tids), ">u8").reshape(-1, 2).astype(np.uint64)
        by_id = np.lexsort((flat[:, 1], flat[:, 0]))
        ids = np.empty(len(flat), np.int64)
        ids[by_id] = np.cumsum(np.append(False, (flat[by_id[1:]] != flat[by_id[:-1]]).any(axis=1))[:len(flat)])
        turns, sizes = np.full(there.shape, -1, np.int64), np.zeros(there.shape, np.int64)
        turns[there], sizes[there] = ids, pa.concat_arrays(rows.column("sizes").chunks).flatten().to_numpy()
        key = np.column_stack([number["panel"], number["pre_hi"], number["pre_lo"]])
        order = np.lexsort((number["conv"], *turns.T[::-1], key[:, 2], key[:, 1], key[:, 0]))
        self.tids, self.key, self.count, self.width = [tids[i] for i in order], key[order], count[order], width
        self.number = {c: v[order] for c, v in number.items()}
        turns, sizes = turns[order], sizes[order]
        change = np.ones((len(tids), width + 1), bool)
        change[1:, 0] = (self.key[1:] != self.key[:-1]).any(axis=1)
        change[1:, 1:] = turns[1:] != turns[:-1]
        self.change = np.logical_or.accumulate(change, axis=1)
        # Bytes from each depth to the conversation's end; the root has none of its own.
        self.tail = np.empty((len(tids), width + 1), np.int64)
        self.tail[:, 1:] = self.number["rest"][:, None] + np.cumsum(sizes[:, ::-1], axis=1)[:, ::-1]
        self.tail[:, 0] = self.tail[:, 1] if width else self.number["rest"]

    def depths(self, totals: dict[tuple[int, int], tuple] | None = None):
        """For each depth: where its nodes start, and their sums; those of nodes that cross the rim are replaced by ``totals``
        ((depth, side) to sums and whether this shard owns the node). Rows that end earlier are runs of their own, not real nodes."""
        own = np.maximum(self.number["own"], 0)
        for depth in range(self.width + 1):
            starts = np.flatnonzero(self.change[:, depth])
            charge = self.number["n"] * self.tail[:, depth] - np.minimum(self.tail[:, depth], own)
            sums = [np.add.reduceat(self.number["n"], starts), np.minimum.reduceat(self.number["conv"], starts),
                    np.add.reduceat(self.number["leaf"], starts), np.add.reduceat(charge, starts)]
            real = self.count[starts] >= depth
            mine = real.copy()
            for side, at in ((0, 0), (1, -1)):
                if totals and (depth, side) in totals:
                    *whole, owner = totals[depth, side]
                    for column, value in zip(sums, whole):
                        column[at] = value
                    mine[at] &= owner
            yield depth, starts, real, mine, sums

    def path(self, row: int, depth: int) -> bytes:
        return hashlib.sha256(b"%d:%d:%d:%d:" % (*self.key[row].tolist(), depth) + self.tids[row][:ID_BYTES * depth]).digest()[:ID_BYTES]


def _partials(rows: pa.Table, rim: pa.Table) -> pa.Table:
    """Sums of the nodes that the shard shares with the shard before (side 0) or after (side 1)."""
    matrix, (about,) = Matrix(rows), rim.to_pylist()
    shared = []
    for row, kind in ((0, "before"), (-1, "after")):
        other = about[kind]
        same = other is not None and [other["panel"], other["pre_hi"], other["pre_lo"]] == matrix.key[row].tolist()
        shared.append(_shared(other["tids"], matrix.tids[row]) if same else -1)
    made = []
    for depth, starts, _, _, sums in matrix.depths():
        for side, at in ((0, 0), (1, -1)):
            # A node that fills the shard is told once.
            if depth <= shared[side] and not (side == 1 and len(starts) == 1 and depth <= shared[0]):
                made.append((about["shard"], depth, side, matrix.path(at, depth), *(int(s[at]) for s in sums)))
    fields = [("shard", pa.int64()), ("depth", pa.int32()), ("side", pa.int32()), ("path", pa.binary()), *((c, pa.int64()) for c in ("convs", "least", "leaves", "saved"))]
    columns = zip(*made) if made else [[]] * len(fields)
    return pa.table([pa.array(list(c), t) for c, (_, t) in zip(columns, fields)], [name for name, _ in fields])


def _totals(rim: pa.Table) -> dict[tuple[int, int], tuple]:
    return {(r["depth"], r["side"]): (r["convs"], r["least"], r["leaves"], r["saved"], r["owner"]) for r in rim.to_pylist()}


def _look(rows: pa.Table, rim: pa.Table) -> pa.Table:
    """Per row: bytes from where it is the least member on (-1: nowhere here), the least member of the node it ends at, and
    whether nothing extends it (both only where it ends)."""
    if not rows.num_rows:
        return pa.table([pa.array([], pa.int64())] * 4, ["conv", "own", "end_conv", "leaf"])
    matrix = Matrix(rows)
    conv, count, panel = matrix.number["conv"], matrix.count, matrix.number["panel"]
    ends = panel * WIDTH + count == matrix.number["len"]
    own, end_conv, leaf = np.full(len(conv), -1), np.zeros(len(conv), np.int64), np.zeros(len(conv), np.int64)
    for depth, _, _, _, (convs, least, *_) in matrix.depths(_totals(rim)):
        run = np.cumsum(matrix.change[:, depth]) - 1
        real = (count >= depth) & ((depth > 0) | (panel == 0))
        own = np.where(real & (least[run] == conv), np.maximum(own, matrix.tail[:, depth]), own)
        at = ends & (count == depth)
        end_conv[at], leaf[at] = least[run][at], (convs[run] == matrix.number["n"])[at]
    return pa.table([pa.array(conv), pa.array(own), pa.array(end_conv, mask=~ends), pa.array(leaf, mask=~ends)], ["conv", "own", "end_conv", "leaf"])


def _count(rows: pa.Table, rim: pa.Table) -> pa.Table:
    """The nodes that this shard owns."""
    made = [[np.empty(0, np.int64)] for _ in range(6)]
    if rows.num_rows:
        matrix = Matrix(rows)
        panel, up = matrix.number["panel"], None
        for depth, starts, real, mine, (convs, least, leaves, saved) in matrix.depths(_totals(rim)):
            run = np.cumsum(matrix.change[:, depth]) - 1
            mine &= (depth > 0) | (panel[starts] == 0)
            parent = np.full(len(starts), -1, np.int64) if up is None else up[starts]
            for column, values in zip(made, (least, panel[starts] * WIDTH + depth, parent, convs, leaves, saved)):
                column.append(values[mine])
            up = least[run]
    columns = [np.concatenate(c) for c in made]
    parents = pa.array(columns[2], mask=columns[1] == 0)
    return pa.table([pa.array(columns[0]), pa.array(columns[1]), parents, *map(pa.array, columns[3:])], ["conv", "depth", "parent", "convs", "leaves", "saved"])


def _measure(rows: DataFrame, rim: DataFrame, each, schema: str, folder: str, name: str) -> DataFrame:
    """``each`` over every shard, given the sums of the nodes that cross its rim."""
    partials = stage(rows.groupBy("shard").cogroup(rim.groupBy("shard")).applyInArrow(_partials, PARTIALS), folder, f"{name}-partials")
    sums = partials.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("convs", "leaves", "saved")], F.min("least").alias("least"), F.min("shard").alias("first"))
    whole = partials.select("shard", "depth", "side", "path").join(sums, "path").withColumn("owner", F.col("shard") == F.col("first"))
    return stage(rows.groupBy("shard").cogroup(whole.groupBy("shard")).applyInArrow(each, schema), folder, name)


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All nodes of the trie over the rebuilt conversations: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``conversations``: ``conv_id``, ``turn``, ``role``, ``text``. Rows without a conv_id belong to no conversation. Turns stand in the order of
    ``turn``, null first; turns that share a number stand in the order of the SHA-256 of role and text, and rows equal in all are turns
    of their own. Null role or text is empty. A negative id belongs to the family that ``conv_id - conv_id % 5`` names as SQL computes it. An empty table has no node, not
    even a root. Other columns are not read.
    """
    folder = run_folder(conversations.sparkSession, "trie")
    convs, turns = rebuilt(conversations, folder)
    panels = stage(_panels(turns, folder), folder, "prefixed")
    classes = _classes(convs, panels, folder)

    about = classes.select("conv", "n", "len")
    columns = ["panel", "pre_hi", "pre_lo", "tids", "sizes", "rest", "conv", "n", "len"]
    zero = F.lit(0).cast("long")
    turnless = about.where("len = 0").select(
        zero.alias("panel"), zero.alias("pre_hi"), zero.alias("pre_lo"), F.lit(b"").alias("tids"), F.array().cast("array<long>").alias("sizes"), zero.alias("rest"), "conv", "n", "len")
    rows = stage(panels.join(about, "conv").select(*columns).union(turnless), folder, "rows")
    placed = places.sorted_rows(rows, ["panel", "pre_hi", "pre_lo", "tids", "conv"], folder, "sorted")
    # Shards are numbered through: a part's own, after those of the parts before (one row a part).
    place = F.floor((F.col("seq") - F.shiftleft(F.col("part").cast("long"), 33)) / shard_rows)
    parts = placed.groupBy("part").agg((F.max(place) + 1).alias("held"))
    before = F.coalesce(F.sum("held").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = stage(placed.join(parts.select("part", before.alias("before")), "part").withColumn("shard", F.col("before") + place).drop("part", "before"), folder, "cut")
    ends = cut.withColumn("edge", F.struct("panel", "pre_hi", "pre_lo", "tids")).groupBy("shard").agg(F.min_by("edge", "seq").alias("head"), F.max_by("edge", "seq").alias("tail"))
    left, right = ends.select((F.col("shard") + 1).alias("shard"), F.col("tail").alias("before")), ends.select((F.col("shard") - 1).alias("shard"), F.col("head").alias("after"))
    rim = stage(ends.select("shard").join(left, "shard", "left").join(right, "shard", "left"), folder, "rim")
    cut = cut.drop("seq")

    looked = _measure(cut.withColumns({"own": zero, "leaf": zero}), rim, _look, LOOKED, folder, "looked")
    charged = stage(looked.groupBy("conv").agg(*[F.max(c).alias(c) for c in ("own", "end_conv", "leaf")]), folder, "charged")
    nodes = _measure(cut.join(charged.select("conv", "own", "leaf"), "conv"), rim, _count, NODES, folder, "nodes")

    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("children"))
    stops = classes.join(charged, "conv").select(F.col("end_conv").alias("conv"), F.col("len").alias("depth"), "ends")
    return nodes.join(children, ["conv", "depth"], "left").join(stops, ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("convs").alias("n_convs"), F.coalesce("children", F.lit(0)).alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


SQL = f"""WITH RECURSIVE {places.CRC_TABLE},
turns AS (
    SELECT conv_id, turn, strlen(coalesce(text, '')) AS b, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(b ORDER BY turn NULLS FIRST, k) AS bs FROM turns GROUP BY conv_id
), hs AS (SELECT *, {places.crc_sql('conv_id')} % {HEADS} AS h FROM own, crc_table
), rebuilt AS (
    SELECT o.conv_id, coalesce(b.ks[1:o.h], []) || o.ks[o.h + 1:] AS ks, coalesce(b.bs[1:o.h], []) || o.bs[o.h + 1:] AS bs
    FROM hs o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % {FAMILY}
), paths AS (SELECT conv_id, ks, bs, unnest(range(0, len(ks) + 1)) AS depth FROM rebuilt
), nodes AS (
    SELECT array_to_string(ks[1:depth], '') AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(bs[depth]), 0) AS b,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(ks) = depth), '') AS ends
    FROM paths GROUP BY 1, 2
), children AS (SELECT left(path, 64 * (depth - 1)) AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2
), counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path, depth)
), below AS (
    SELECT a.path, CAST(count(*) FILTER (WHERE b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.b) AS BIGINT) AS saved_tokens
    FROM counted a JOIN counted b ON starts_with(b.path, a.path) GROUP BY a.path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN below b USING (path) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = left(n.path, 64 * (n.depth - 1))"""


@query(SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie over all rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
