"""A Merkle manifest of a dataset, with a witness for every row, kept while rows are appended.

Leaves of a group stand in order; every ``FANOUT`` consecutive nodes have one parent, the last run may be shorter, and a
single node is the group's root. The roots of the groups make a tree of their own, whose root stands for the table.

Leaves are appended in their order, in blocks of ``FANOUT ** LEVELS`` places. An open subtree keeps its finished children,
and each leaf below them the part of its witness that is known so far; when a sibling completes the run, the digests of the
siblings are added to the witnesses of the whole subtree, which becomes one child of the next level. A block holds a bounded number
of leaves and blocks are aligned, so each is one task's work and its root is a node of the whole tree. The roots are then appended
in blocks by the same code: one round for each LEVELS levels. On the way back each row's witness is its own part and the one
of its block's root.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.llm import places
from itembank.llm.common import query, run_folder, stage, table

#: Children of a node, and levels of a block (4,096 leaves).
FANOUT, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NODE = "grp string, pos long, total long, digest binary, doc_id long, other binary"
BLOCK_ROWS = f"{NODE}, witness binary, root boolean"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (binary) of the fields, each ``-`` if null, else its bytes in UTF-8, a colon and itself."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def node_digest(children: list[bytes]) -> bytes:
    """SHA-256 of the children's digests as hex text."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


class Block:
    """An aligned block while its leaves are appended.

    ``open[l]``: finished nodes of level ``l`` whose run is not complete, each with the places of the leaves below it.
    ``witness``: for each leaf, the siblings known so far, from its own run upwards, left to right.
    """

    def __init__(self, levels: int):
        self.open: list[list[tuple[bytes, range]]] = [[] for _ in range(levels)]
        self.witness: list[bytearray] = []
        self.root: bytes | None = None

    def append(self, digest: bytes) -> None:
        at = len(self.witness)
        self.witness.append(bytearray())
        self._put(0, (digest, range(at, at + 1)))

    def _put(self, level: int, node: tuple[bytes, range]) -> None:
        if level == len(self.open):
            self.root = node[0]
            return
        self.open[level].append(node)
        if len(self.open[level]) == FANOUT:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [digest for digest, _ in run]
        for i, (_, leaves) in enumerate(run):
            siblings = b"".join(digests[:i] + digests[i + 1:])
            for leaf in leaves:
                self.witness[leaf] += siblings
        self._put(level + 1, (node_digest(digests), range(run[0][1].start, run[-1][1].stop)))

    def close(self) -> bytes:
        """End of the group: runs that are not full are complete as they are."""
        for level, run in enumerate(self.open):
            if run:
                self._complete(level)
        return self.root


def _append(levels: int):
    """Rows in the order of (grp, block, pos), blocks whole: the same with their witness, and one row for each block's root."""
    size = FANOUT ** levels
    names = ["grp", "pos", "total", "digest", "doc_id", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            at = 0
            root = block.close()
            for part in held:
                made = pa.array([bytes(w) for w in block.witness[at:at + part.num_rows]], pa.binary())
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, made, pa.array([False] * part.num_rows)], [*names, "witness", "root"])
            grp, number, total = current
            values = [grp, number, -(-total // size), root, None, None, None, True]
            types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [*names, "witness", "root"])

        for batch in batches:
            part = batch.select(names)
            keys = [(g, p // size, t) for g, p, t in zip(*(part.column(c).to_pylist() for c in ("grp", "pos", "total")))]
            digests = part.column("digest").to_pylist()
            start = 0
            for i, key in enumerate(keys):
                if key != current:
                    if i > start:
                        held.append(part.slice(start, i - start))
                    if block:
                        yield from done()
                    current, held, block, start = key, [], Block(min(levels, height(key[2]))), i
                block.append(digests[i])
            if part.num_rows > start:
                held.append(part.slice(start))
        if block:
            yield from done()

    return run


def _rounds(nodes: DataFrame, levels: int, folder: str, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Append ``nodes`` (NODE), then block roots, until every group has one: rows of each round, and the groups' roots."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    done = []
    while True:
        number = F.floor(F.col("pos") / FANOUT ** levels)
        blocks = nodes.withColumn("block", number).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
        rows = stage(blocks.drop("block").mapInArrow(_append(levels), BLOCK_ROWS), folder, f"{name}-{len(done)}")
        done.append(rows.where("NOT root"))
        nodes = rows.where("root").drop("witness", "root")
        most = -(-most // FANOUT ** levels)
        if most <= 1:
            return done, nodes


def _whole(rounds: list[DataFrame], levels: int, above: DataFrame) -> DataFrame:
    """Rows of the first round with their witness up to the top. ``above``: of every group's root (grp, 0) its witness and
    what else is to come down. A block holds a bounded number of rows, so no key of these joins is large."""
    more = [c for c in above.columns if c not in ("grp", "pos", "witness")]
    for rows in reversed(rounds):
        up = above.select(F.col("grp").alias("__grp"), F.col("pos").alias("__block"), F.col("witness").alias("__up"), *more)
        joined = rows.join(up, F.col("grp").eqNullSafe(F.col("__grp")) & (F.floor(F.col("pos") / FANOUT ** levels) == F.col("__block")))
        above = joined.withColumn("witness", F.concat("witness", "__up")).drop("__grp", "__block", "__up", "root")
    return above


def manifest(rows: DataFrame, group: str = "grp", levels: int = LEVELS) -> DataFrame:
    """Witness of every row up to the root of the table.

    ``rows``: ``group`` (any string or null), ``doc_id`` (the order in the group, null first), ``digest`` (its leaf, binary),
    and ``other`` (binary, carried along). Returns those and ``pos``, ``total`` (place in the group and its rows), ``subroot``,
    ``top_pos``, ``top_total`` (place of the group, null first, then by UTF-8 bytes, and number of groups), ``top_root`` and ``witness``: the siblings'
    digests from the leaf's run upwards, left to right. Rows that share an id stand in the order of their digests; rows equal in
    both are leaves of their own. ``levels`` sets the size of a block and no result. An empty table gives no row.
    """
    spark = rows.sparkSession
    folder = run_folder(spark, "manifest")
    given = rows.select(F.col(group).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), "digest", "other")
    # The salt tells equal rows apart, so that a value which a third of all rows hold is still cut into ranges.
    leaves = stage(given.withColumn("salt", F.monotonically_increasing_id()), folder, "leaves")
    placed = places.sorted_rows(leaves, ["grp", "doc_id", "digest", "salt"], folder, "placed")
    nodes = places.placed_rows(placed, places.runs(placed, "grp"), "grp").select("grp", "pos", "total", "digest", "doc_id", "other")
    rounds, subroots = _rounds(nodes, levels, folder, "leaf")

    tops = stage(subroots.select(F.lit("").alias("all"), "grp", "digest"), folder, "subroots")
    ordered = places.sorted_rows(tops, ["all", "grp"], folder, "groups")
    groups = places.placed_rows(ordered, places.runs(ordered, "all"), "all")
    # The group's own name travels in ``other`` while its root is a leaf of the upper tree.
    top = groups.select(F.col("all").alias("grp"), "pos", "total", "digest", F.lit(None).cast("long").alias("doc_id"), F.col("grp").cast("binary").alias("other"))
    top_rounds, root = _rounds(top, levels, folder, "top")
    highest = root.select("grp", "pos", F.lit(b"").alias("witness"), F.col("digest").alias("top_root"))
    above = _whole(top_rounds, levels, highest).select(
        F.col("other").cast("string").alias("grp"), F.lit(0).cast("long").alias("pos"), "witness", F.col("digest").alias("subroot"),
        F.col("pos").alias("top_pos"), F.col("total").alias("top_total"), "top_root")
    return _whole(rounds, levels, above).withColumnRenamed("grp", group)


def steps(pos: int, total: int) -> Iterator[tuple[int, int]]:
    """Place in the run and length of the run, from the leaf's level up to the group's root."""
    while total > 1:
        first = pos - pos % FANOUT
        yield pos - first, min(FANOUT, total - first)
        pos, total = pos // FANOUT, -(-total // FANOUT)


def fold(digest: bytes, path: list[tuple[int, int]], siblings: bytes) -> bytes:
    """The root that follows from a leaf and its witness (the siblings' digests, as hex text)."""
    node, at = digest.hex().encode(), 0
    for place, length in path:
        run = siblings[at:at + 64 * (length - 1)]
        at += len(run)
        node = hashlib.sha256(run[:64 * place] + node + run[64 * place:]).hexdigest().encode()
    return bytes.fromhex(node.decode())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        proofs, roots = [], []
        columns = (batch.column(c).to_pylist() for c in ("leaf", "witness", "pos", "total", "top_pos", "top_total"))
        for leaf, witness, pos, total, top_pos, top_total in zip(*columns):
            siblings = witness.hex().encode()
            proofs.append(hashlib.sha256(siblings).hexdigest())
            roots.append(fold(leaf, [*steps(pos, total), *steps(top_pos, top_total)], siblings))
        kept = [c for c in batch.schema.names if c not in ("witness", "leaf")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), pa.array(proofs, pa.string()), pa.array(roots, pa.binary())], [*kept, "proof_sha256", "folded"])


def verify(proved: DataFrame, leaf: Column) -> DataFrame:
    """``proved`` (of ``manifest``) with ``proof_sha256``, the digest of the witness as hex text, and ``folded``, the root that follows
    from the witness and ``leaf``; no shuffle."""
    rows = proved.withColumn("leaf", leaf)
    schema = rows.drop("leaf", "witness").withColumns({"proof_sha256": F.lit(""), "folded": F.lit(b"")}).schema
    return rows.mapInArrow(_verify, schema)


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaf of every row of ``documents`` (``digest``) and, where 3 divides the CRC-32 of the id, that of the row with A-Z of its
    text in lower case (``other``). A null id has no decimal form and is not tampered with."""
    tampered = F.translate("text", UPPER, LOWER)
    columns = lambda text: [F.col(c) if c != "text" else text for c in FIELDS]
    other = F.when(places.crc(F.col("doc_id")) % 3 == 0, leaf_digest(columns(tampered)))
    return docs.select(F.col("lang").alias("grp"), "doc_id", leaf_digest(columns(F.col("text"))).alias("digest"), other.alias("other"))


SQL = f"""WITH RECURSIVE {places.CRC_TABLE},
fields AS (
    SELECT doc_id, lang, n_chars, source, text, CASE WHEN {places.crc_sql('doc_id')} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS changed
    FROM documents, crc_table
), leaves AS (
    SELECT doc_id, lang, sha256(head || {{text}}) AS leaf, sha256(head || {{changed}}) AS other, sha256(head || {{text}}) AS digest
    FROM (SELECT *, {{doc_id}} || {{source}} || {{lang}} || {{n_chars}} AS head FROM fields)
), nodes(grp, lang, level, pos, total, digest) AS (
    SELECT 0, lang, 0, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1, count(*) OVER (PARTITION BY lang), leaf FROM leaves
    UNION ALL
    SELECT 0, lang, level + 1, pos // 8, (total + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE total > 1 GROUP BY lang, level, pos // 8, total
), tops(level, pos, total, digest) AS (
    SELECT 0, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1, count(*) OVER (), digest FROM nodes WHERE total = 1
    UNION ALL
    SELECT level + 1, pos // 8, (total + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE total > 1 GROUP BY level, pos // 8, total
), placed AS (
    SELECT doc_id, lang, leaf, other, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), subroots AS (
    SELECT lang, digest AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS top FROM nodes WHERE total = 1
), path AS (
    SELECT p.doc_id, p.lang, p.pos AS leaf_pos, n.level, n.pos % 8 AS place, n.digest, n.pos = p.pos // CAST(pow(8, n.level) AS BIGINT) AS own
    FROM placed p JOIN nodes n ON n.lang IS NOT DISTINCT FROM p.lang AND n.total > 1 AND n.pos // 8 = p.pos // CAST(pow(8, n.level + 1) AS BIGINT)
    UNION ALL
    SELECT p.doc_id, p.lang, p.pos, 1000 + t.level, t.pos % 8, t.digest, t.pos = s.top // CAST(pow(8, t.level) AS BIGINT)
    FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN tops t ON t.total > 1 AND t.pos // 8 = s.top // CAST(pow(8, t.level + 1) AS BIGINT)
), proofs AS (
    SELECT lang, leaf_pos, sha256(coalesce(string_agg(digest, '' ORDER BY level, place) FILTER (WHERE NOT own), '')) AS proof_sha256 FROM path GROUP BY lang, leaf_pos
), levels AS (
    SELECT lang, leaf_pos, row_number() OVER (PARTITION BY lang, leaf_pos ORDER BY level) AS step,
        coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE NOT own AND place < mine), '') AS before,
        coalesce(string_agg(digest, '' ORDER BY place) FILTER (WHERE NOT own AND place > mine), '') AS after
    FROM (SELECT *, max(CASE WHEN own THEN place END) OVER (PARTITION BY lang, leaf_pos, level) AS mine FROM path) GROUP BY lang, leaf_pos, level
), folded(lang, leaf_pos, step, digest) AS (
    SELECT lang, pos, 0, other FROM placed
    UNION ALL
    SELECT f.lang, f.leaf_pos, f.step + 1, sha256(l.before || f.digest || l.after)
    FROM folded f JOIN levels l ON l.lang IS NOT DISTINCT FROM f.lang AND l.leaf_pos = f.leaf_pos AND l.step = f.step + 1
), ends AS (SELECT lang, leaf_pos, arg_max(digest, step) AS folded_root FROM folded GROUP BY lang, leaf_pos)
SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.digest AS verified
FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT digest FROM tops WHERE total = 1) t ON true
JOIN ends e ON e.lang IS NOT DISTINCT FROM p.lang AND e.leaf_pos = p.pos
LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.leaf_pos = p.pos"""


def _field_sql(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE CAST(strlen(CAST({name} AS VARCHAR)) AS VARCHAR) || ':' || CAST({name} AS VARCHAR) END"


for _name in (*FIELDS, "changed"):
    SQL = SQL.replace("{" + _name + "}", _field_sql(_name))


@query(SQL)
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its leaf, the roots, the digest of its proof, and whether what it has become still folds to the root."""
    proved = manifest(document_leaves(table(spark, sf_dir, "documents")))
    checked = verify(proved, F.coalesce("other", "digest"))
    hexed = lambda c: F.lower(F.hex(c))
    return checked.select(
        "doc_id", hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), hexed("top_root").alias("root"), "proof_sha256",
        hexed("folded").alias("folded_root"), (F.col("folded") == F.col("top_root")).alias("verified"))
