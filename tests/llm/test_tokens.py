"""Token counts, token files and SentencePiece against the libraries, on whole texts."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from rows import SF, empty, hard  # noqa: F401
from tokenizers import Tokenizer

from itembank.llm import pieces, token_counts, token_files, vocab
from itembank.llm.common import run_folder

BPE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def bpe(text):
    return BPE.encode(text or "", add_special_tokens=False).ids


def strange(seed, n=400):
    rng = random.Random(seed)
    parts = ["a", "the", " ", "  ", "\n", "\t", "▁", "é", "漢", "🙂", "'s", "123", "...", "<s>", "<|endoftext|>", " ", "　", "\x1c", "ab", "Ing"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)]


def test_piece_encoder_equals_library():
    texts = strange(1)
    encoder = vocab.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), limit=50)
    for i in range(0, len(texts), 40):
        for text, ids in zip(texts[i:i + 40], encoder.encode(texts[i:i + 40])):
            assert np.frombuffer(ids, "<u4").tolist() == bpe(text), text


def test_prefix_table_equals_library(monkeypatch):
    monkeypatch.setattr(pieces, "UNITS", 100)
    table = pieces.PrefixTable(public_tokenizers.path("piece_bpe_32k.model"))
    for text in [*strange(2), "a" * 2000, " " * 500, "ab" * 900, "de la " * 300]:
        assert np.frombuffer(table.encode(text), "<i4").tolist() == PIECES.encode(text), text[:80]


def test_counts_and_cache(spark, hard, empty):
    cache = run_folder(spark, "cache") + "/counts"
    first = token_counts.count_tokens(hard, cache).collect()
    assert len(first) == hard.count()
    texts = {r.doc_id: r.text for r in hard.collect()}
    for r in first:
        assert (r.n_bytes, r.n_tokens) == (len((texts[r.doc_id] or "").encode()), len(bpe(texts[r.doc_id])))
    stored = spark.read.parquet(cache).count()
    again = token_counts.count_tokens(hard.limit(5).union(hard), cache)
    assert again.count() == hard.count() + 5 and spark.read.parquet(cache).count() == stored
    assert token_counts.count_tokens(empty, cache).count() == 0


def test_repeated_rows_are_encoded_once(spark):
    rows = spark.createDataFrame([(7, "one text")] * 1000 + [(7, "another"), (None, "one text"), (9, None)], "doc_id long, text string")
    cache = run_folder(spark, "cache") + "/counts"
    assert token_counts.count_tokens(rows, cache).count() == 1003
    assert spark.read.parquet(cache).count() == 3


def test_counts_need_no_encoder_for_hits(spark, hard, monkeypatch):
    cache = run_folder(spark, "cache") + "/counts"
    token_counts.count_tokens(hard, cache)
    assert token_counts.read_cache(spark, cache).where("n_tokens < 0").count() == 0
    files = set(f for f in spark.read.parquet(cache).inputFiles())
    token_counts.count_tokens(hard, cache)
    new = [f for f in spark.read.parquet(cache).inputFiles() if f not in files]
    assert not new or spark.read.parquet(*new).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000, 70_000])
def test_pack_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.2, n) % 200_000).astype("<u4") if n != 70_000 else np.arange(n, dtype="<u4")
    ranked, control, data = token_files.pack(ids)
    assert token_files.unpack(n, ranked, control, data).tolist() == ids.tolist()


def test_files_round_trip(spark, hard, empty):
    path = run_folder(spark, "ids") + "/files"
    token_files.write_ids(hard, path, block_ids=100)
    rows = token_files.with_starts(token_files.read_ids(spark, path)).orderBy("start").collect()
    expected = sorted(((r.doc_id is not None, r.doc_id or 0), bpe(r.text) + [2]) for r in hard.collect())
    assert [((r.doc_id is not None, r.doc_id or 0), np.frombuffer(r.ids, "<u4").tolist()) for r in rows] == expected
    assert [r.start for r in rows] == [sum(len(e[1]) for e in expected[:i]) for i in range(len(expected))]
    nothing = run_folder(spark, "ids") + "/files"
    token_files.write_ids(empty, nothing)
    assert token_files.with_starts(token_files.read_ids(spark, nothing)).count() == 0


def test_encode_decode(spark, hard, empty):
    rows = pieces.encode_decode(hard, ["doc_id", "text"], list(pieces.OUTPUTS)).collect()
    assert len(rows) == hard.count()
    for r in rows:
        ids = PIECES.encode(r.text or "")
        decoded = PIECES.decode(ids) if ids else ""
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), decoded)
        assert (r.ids_sha256, r.decoded_sha256) == (sha(",".join(map(str, ids))), sha(decoded))
    assert pieces.encode_decode(empty, ["doc_id"], ["ids"]).count() == 0


def test_queries(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = {r.doc_id: r.n_tokens for r in token_counts.op2_token_counts(spark, sf).collect()}
    assert counts == {i: len(bpe(t)) for i, t in docs.items()}
    lengths = {r.doc_id: r.n_tokens for r in token_files.op6_token_files(spark, sf).collect()}
    assert lengths == {i: n + 1 for i, n in counts.items()}
    got = {r.doc_id: r.n_tokens for r in pieces.op8_sentencepiece(spark, sf).collect()}
    assert got == {i: len(PIECES.encode(t)) for i, t in docs.items()}
