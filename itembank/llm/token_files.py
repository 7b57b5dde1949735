"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length coding, control bytes apart.

A file is a sequence of blocks, a block holds whole documents (about ``BLOCK_IDS`` ids, or one longer document):

    magic, shard, block, n_docs, n_ids, n_ranks, n_data        4s, then unsigned 32-bit integers
    doc ids                                                    8 bytes each, and one byte each: 1 if null
    ids of each document                                       unsigned 32-bit
    rank table                                                 the id of each rank, most frequent first, unsigned 32-bit
    control bytes                                              two bits an id: bytes of its rank, less one
    data bytes                                                 the ranks, 1 to 4 bytes each, little-endian
    line feed

All integers are little-endian. A block has its own rank table, so it can be written in one pass and read alone, and a
lost task writes its own files again and no others. Spark's text writer writes the blocks as they are (a cast from
binary to string keeps the bytes) and commits them, so any store that Spark writes to can hold the files.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itembank.llm import vocab
from itembank.llm.common import query, run_folder, slices, stage, table

BLOCK_IDS = 1 << 20
BLOCKS_PER_FILE = 32
END_ID = 2
HEAD = struct.Struct("<4s6I")
MAGIC = b"TID1"

#: Bytes of each of a control byte's four ranks.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank table, control bytes and data bytes of ``ids``, which lie below the size of a vocabulary."""
    counts = np.bincount(ids)
    seen = np.flatnonzero(counts)
    ranked = seen[np.argsort(-counts[seen], kind="stable")]
    rank = np.empty(len(counts), np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    ranks = rank[ids]
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    codes[:len(ids)] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    ends = np.cumsum(extra.astype(np.int64) + 1)
    starts = ends - extra - 1
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    data[starts] = ranks & 0xFF
    for byte in range(1, int(extra.max(initial=0)) + 1):
        wide = np.flatnonzero(extra >= byte)
        data[starts[wide] + byte] = ranks[wide] >> (8 * byte) & 0xFF
    return ranked.astype("<u4"), control, data


def unpack(n: int, ranked: np.ndarray, control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The ``n`` ids that ``pack`` was given: lengths by table lookup, then ids by table lookup."""
    lengths = LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    ranks = data[starts].astype(np.uint32)
    for byte in range(1, int(lengths.max(initial=1))):
        wide = np.flatnonzero(lengths > byte)
        ranks[wide] |= data[starts[wide] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return ranked[ranks]


def block_bytes(shard: int, block: int, doc_ids: list[int | None], documents: list[bytes]) -> bytes:
    ids = np.frombuffer(b"".join(documents), "<u4")
    ranked, control, data = pack(ids)
    head = HEAD.pack(MAGIC, shard, block, len(documents), len(ids), len(ranked), len(data))
    return b"".join([
        head, np.array([i or 0 for i in doc_ids], "<i8").tobytes(), bytes(i is None for i in doc_ids),
        np.array([len(d) // 4 for d in documents], "<u4").tobytes(), ranked.tobytes(), control.tobytes(), data.tobytes(),
    ])


def blocks_of(content: memoryview) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(shard, block, doc ids, lengths, ids) of each block of a file's content."""
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, n, at)
        at += out.nbytes
        return out

    while at < len(content):
        magic, shard, block, n_docs, n_ids, n_ranks, n_data = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at += HEAD.size
        doc_ids, nulls, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
        ids = unpack(n_ids, take("<u4", n_ranks), take("u1", -(-n_ids // 4)), take("u1", n_data))
        at += 1
        yield shard, block, [None if null else i for i, null in zip(doc_ids.tolist(), nulls.tolist())], lengths, ids


def _encode(path: str | None, name: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, block = vocab.encoder(path or vocab.tokenizer_path(name)), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        doc_ids: list[int | None] = []
        documents: list[bytes] = []
        held = 0

        def row(content: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

        for part in slices(batches, "text"):
            texts = encoder.encode([t or "" for t in part.column("text").to_pylist()])
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), texts):
                doc_ids.append(doc_id)
                documents.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= block_ids:
                    yield row(block_bytes(shard, block, doc_ids, documents))
                    doc_ids, documents, held, block = [], [], 0, block + 1
        if documents:
            yield row(block_bytes(shard, block, doc_ids, documents))

    return run


def write_ids(
    docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", tokenizer_path: str | None = None,
    end_id: int = END_ID, block_ids: int = BLOCK_IDS, doc_id: str = "doc_id", text: str = "text",
) -> None:
    """Write the ids of every whole text, ``end_id`` after each, in ascending order of ``doc_id``.

    Documents are dealt out by ranges of (id, digest of the text), so neither an id that repeats nor long documents make
    a part uneven. Null ids come first; rows that share an id are in the order of digest, then text; a null text is
    empty and has only its end id; an empty table gives no block. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    blocks = ordered.mapInArrow(_encode(tokenizer_path, tokenizer, end_id, block_ids), "content binary")
    blocks.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path)


def _decode(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for shard, block, doc_ids, lengths, ids in blocks_of(memoryview(content.as_buffer())):
                    ends = np.cumsum(lengths, dtype=np.int64)
                    starts = ends - lengths
                    raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                    cuts = [raw[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                    last = pa.array(cuts, pa.binary()) if with_ids else pa.array([zlib.crc32(c) for c in cuts], pa.int64())
                    n = len(doc_ids)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc_ids, pa.int64()), pa.array([shard] * n, pa.int64()), pa.array([block] * n, pa.int64()),
                        pa.array(starts), pa.array(lengths.astype(np.int64)), last,
                    ], ["doc_id", "shard", "block", "at", "n_tokens", "ids" if with_ids else "ids_crc32"])

    return run


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: where it stands, its length, and its ids (binary, unsigned 32-bit
    little-endian) or, without ``with_ids``, their CRC-32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    last = "ids binary" if with_ids else "ids_crc32 long"
    return files.mapInArrow(_decode(with_ids), f"doc_id long, shard long, block long, at long, n_tokens long, {last}")


def with_starts(rows: DataFrame) -> DataFrame:
    """``start``, the ids of all documents before each. Totals are summed per block, then per shard; a window sees the
    blocks of one shard, or one row per shard."""
    blocks = rows.groupBy("shard", "block").agg(F.sum("n_tokens").alias("n"))
    inner = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    outer = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("shard_at"))
    offsets = blocks.select("shard", "block", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("block_at")).join(shards, "shard")
    return rows.join(offsets, ["shard", "block"]).withColumn("start", F.col("shard_at") + F.col("block_at") + F.col("at"))


@query()
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the files and back."""
    folder = run_folder(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), f"{folder}/files")
    rows = stage(read_ids(spark, f"{folder}/files", with_ids=False), folder, "rows")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
