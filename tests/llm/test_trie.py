"""The prefix trie against a plain one, over panels, shards and hard rows."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from itembank.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, shard string"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        family = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = (*own.get(family, [])[:h], *turns[h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, inside in members.items():
        gain = (len(inside) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += gain
    out = []
    for path, inside in members.items():
        ends = ",".join(map(str, sorted(c for c in inside if rebuilt[c] == path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(inside), len(path), parent, len(inside), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, shard_rows=trie.SHARD_ROWS):
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    made = trie.prefix_trie(table, shard_rows)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert made.columns == names
    got = sorted((tuple(r) for r in made.collect()), key=str)
    assert got == plain(rows)
    return got


def family(rng, convs=60):
    """Conversations that share first turns of many lengths, up to three panels; copies; ends on the rim of a panel."""
    base = [("user", f"t{i}") for i in range(200)]
    rows = []
    for c in range(convs):
        upto = rng.choice([0, 1, 3, 9, 63, 64, 65, 128, 130, 190])
        path = base[:upto] + [("assistant", f"own {rng.randrange(4)}")] * rng.choice([0, 0, 1, 2, 70])
        rows += [(c, i, *turn) for i, turn in enumerate(path)]
    return rows


@pytest.mark.parametrize("shard_rows", [2, trie.SHARD_ROWS])
def test_panels_and_shards(spark, shard_rows):
    check(spark, family(random.Random(5)), shard_rows)


def test_hard_rows(spark):
    rows = [
        (0, 0, "user", "Hello"), (0, 1, "assistant", "é 漢字 🙂"), (0, None, None, "first of all"), (0, 1, "assistant", "tie"), (0, 1, "assistant", "tie"),
        (1, 0, None, None), (1, 1, "", ""), (2, 5, "user", ""), (3, None, None, None), (4, 0, "user", "Hello" * 30_000), (None, 0, "user", "of no conversation"),
        (7, 0, "a", "bc"), (8, 0, "ab", "c"), (10, 0, "user", "Hello"), (11, 0, "user", "Hello"), (12, 0, "user", "Hello"), (-3, 0, "user", "Hello"), (-5, 0, "user", "Hello"),
        (9_000_000_000, 0, "user", "Hello"), (9_000_000_002, 3, "user", "later"),
    ]
    nodes = check(spark, rows, 3)
    assert sum(1 for n in nodes if n[1] == 0) == 1


def test_turnless_and_empty(spark):
    # 1 takes 2 turns of the absent conversation 0 and has one of its own, so it has none.
    assert zlib.crc32(b"1") % 9 >= 1
    ((conv, depth, parent, convs, children, leaves, saved, ends),) = check(spark, [(1, 0, "user", "x")])
    assert (conv, depth, parent, convs, children, leaves, saved) == (1, 0, None, 1, 0, 1, 0) and ends == hashlib.sha256(b"1").hexdigest()
    assert check(spark, []) == []


def test_a_third_of_all_conversations_are_equal(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 300, 5) for t in range(4)]
    rows += [(c, t, "user", f"other {c} {t}") for c in range(1, 300, 3) for t in range(3)]
    check(spark, rows, 7)


def test_joined_ids_run_over_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "JOINED", 3)
    import pyarrow as pa

    ids = [(1, 1, 2, c) for c in range(10)] + [(1, 2, 2, 77)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*ids[i:i + 4])], ["hi", "lo", "len", "conv"]) for i in range(0, 11, 4)]
    runs = list(trie._join_ids(iter(batches)))
    assert max(r.column("n")[0].as_py() for r in runs) == 3
    (out,) = pa.Table.from_batches(list(trie._digest_ids(iter(runs)))).to_pydict(),
    assert out["n"] == [10, 1] and out["ends"][0] == hashlib.sha256(",".join(map(str, range(10))).encode()).hexdigest()
