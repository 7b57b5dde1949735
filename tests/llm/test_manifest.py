"""The Merkle manifest against a plain construction, and on hard rows."""
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from rows import empty, hard  # noqa: F401

from itembank.llm import manifest as m


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(digests):
    """Root, and for each leaf the runs that it is proved by: (place, run) from its own level up."""
    levels, paths = [list(digests)], [[] for _ in digests]
    while len(levels[-1]) > 1:
        runs = [levels[-1][i:i + 8] for i in range(0, len(levels[-1]), 8)]
        for i, path in enumerate(paths):
            at = i // 8 ** (len(levels) - 1)
            path.append((at % 8, runs[at // 8]))
        levels.append([sha(*run) for run in runs])
    return levels[-1][0], paths


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row, row["text"]), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for name in names:
        groups[name].sort(key=lambda t: t[:3])
    trees = {name: tree([t[2] for t in groups[name]]) for name in names}
    root, tops = tree([trees[name][0] for name in names])
    out = []
    for name, top in zip(names, tops):
        subroot, paths = trees[name]
        for (_, _, digest, row), path in zip(groups[name], paths):
            path = path + top
            siblings = [d for place, run in path for i, d in enumerate(run) if i != place]
            tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
            node = leaf(row, lowered(row["text"])) if tampered else digest
            for place, run in path:
                node = sha(*run[:place], node, *run[place + 1:])
            out.append((row["doc_id"], digest, subroot, root, sha(*siblings), node, node == root))
    return out


def order(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


def result(docs, levels=m.LEVELS):
    checked = m.verify(m.manifest(m.document_leaves(docs), levels=levels), F.coalesce("other", "digest")).collect()
    return sorted(((r.doc_id, r.digest.hex(), r.subroot.hex(), r.top_root.hex(), r.proof_sha256, r.folded.hex(), r.folded == r.top_root) for r in checked), key=order)


def expected(docs):
    return sorted(plain([r.asDict() for r in docs.collect()]), key=order)


@pytest.mark.parametrize("levels", [1, 4])
def test_hard_rows(spark, hard, levels):
    assert result(hard, levels) == expected(hard)


def test_many_groups_and_rounds(spark):
    """Blocks of eight leaves, three rounds; a hundred groups; a third of the rows equal in everything."""
    docs = spark.range(600).selectExpr(
        "id as doc_id", "concat('Text ', id) as text", "IF(id < 300, 'en', concat('l', id % 100)) as lang", "'s' as source", "id as n_chars", "1 as pos", "2 as witness")
    equal = spark.range(200).selectExpr("7L as doc_id", "'Same' as text", "'en' as lang", "'s' as source", "4L as n_chars", "1 as pos", "2 as witness")
    docs = docs.union(equal)
    assert result(docs, levels=1) == expected(docs)


def test_empty_and_single(spark, hard, empty):
    assert result(empty) == []
    one = hard.where("doc_id = 2")
    (row,) = result(one)
    assert row[1] == row[2] == row[3] and row[4] == sha("")


def test_a_changed_leaf_never_folds_to_the_root(spark, hard):
    proved = m.manifest(m.document_leaves(hard))
    changed = m.verify(proved, F.unhex(F.sha2(F.col("digest"), 256)))
    assert changed.where("folded = top_root").count() == 0
    assert m.verify(proved, F.col("digest")).where("folded <> top_root").count() == 0


def test_blocks_are_aligned_subtrees():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(100)]
    block = m.Block(3)
    for digest in digests:
        block.append(digest)
    root, paths = tree([d.hex() for d in digests])
    assert block.close().hex() == root
    for made, path in zip(block.witness, paths):
        assert made.hex() == "".join(d for place, run in path for i, d in enumerate(run) if i != place)
