"""Near-duplicates, repeats, mixing and toxicity against brute force, and on hard rows."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import SF, empty, hard  # noqa: F401

from itembank.llm import mixing, repeats, setsketch, toxicity


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def brute_components(docs, width, percent=80):
    sets = {i: shingle_set(t, width) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in docs}, sets


def near_group(spark, n=150, seed=3):
    """Variants of one text, none of which is the base, among unrelated texts: many links, no common centre."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    docs = {}
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(80), rng.randint(0, 9)):
            words[at] = f"x{rng.randrange(10**6)}"
        docs[i] = " ".join(words)
    for i in range(n, n + 40):
        docs[i] = " ".join(f"u{rng.randrange(500)}" for _ in range(rng.randint(1, 60)))
    return docs, spark.createDataFrame(list(docs.items()), "doc_id long, text string")


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(spark, width):
    docs, table = near_group(spark)
    expected, sets = brute_components(docs, width)
    rows = setsketch.near_duplicates(table, width).collect()
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in rows)


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]
    x, y = (setsketch.registers(s)[None, :] for s in (a, b))
    assert abs(setsketch.estimate(x, y, np.array([2000.0]), np.array([2000.0]))[0] - 0.6) < 0.15
    both = np.maximum(x, y)
    assert (setsketch.registers(pool[:2500]) == both[0]).all()


def test_an_id_links_the_classes_of_its_texts(spark):
    a, b, c = ("alpha beta gamma delta", "one two three four", "red green blue grey")
    rows = [(3, a), (5, a), (5, b), (8, b), (9, c), (1, c), (9, ""), (12, None), (12, "lone words here")]
    got = {(r.doc_id, r.component_id, r.kept) for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3, True), (5, 3, False), (8, 3, False), (1, 1, True), (9, 1, False), (12, 12, True)}


def test_near_duplicates_hard_rows(spark, hard, empty):
    rows = setsketch.near_duplicates(hard).collect()
    assert len(rows) == hard.count()
    got = {r.doc_id: (r.component_id, r.kept) for r in rows}
    assert got[1] == (1, True) and got[7] == (1, False) and got[10] == (1, False)
    assert got[2] == (2, True) and got[3] == (3, True) and got[11] == (11, True) and got[None] == (None, True) and got[9] == (9, True)
    assert setsketch.near_duplicates(empty).count() == 0


def brute_repeats(docs, length):
    seen, out = set(), {}
    for i in sorted(docs):
        raw = (docs[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - length + 1):
            if raw[a:a + length] in seen:
                gone[a:a + length] = True
            seen.add(raw[a:a + length])
        rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(raw) else 0
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + [1, 2, 3, 26, 2, 4][seed], 700).astype(np.uint8)
    if seed == 4:
        text = np.tile(text[:50], 14)
    raw, depth = text.tobytes(), 60
    order = repeats.suffix_array(text, depth)
    assert sorted(order.tolist()) == list(range(len(raw)))
    keys = [raw[i:i + depth] for i in order.tolist()]
    assert keys == sorted(keys)
    lcp = repeats.common_prefixes(text, order, depth)
    padded = raw + bytes(depth)
    for n in range(1, len(order)):
        a, b = (padded[i:i + depth] for i in (order[n - 1], order[n]))
        assert lcp[n] == next((k for k in range(depth) if a[k] != b[k]), depth)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 8)))
    shared = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(4)]
    docs = {i: " ".join(rng.choice(shared) if rng.random() < 0.4 else word() for _ in range(rng.randint(0, 40))) for i in range(60)}
    docs[60], docs[61], docs[62] = docs[5], None, "z" * 250
    return docs


@pytest.mark.parametrize("crowd", [4096, 3])
def test_repeats_equal_brute_force(spark, crowd, monkeypatch):
    """Also with crowded anchors, whose windows are compared by digest."""
    docs = passages(1)
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    rows = repeats.without_repeats(table, ["doc_id"], crowd=crowd).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == brute_repeats(docs, 100)


def test_settle_in_small_batches(monkeypatch):
    """Rows of one anchor that come in many batches give what they give at once."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = np.stack([rng.integers(0, 4, 500), rng.integers(0, 40, 500), rng.integers(0, 50, 500), rng.integers(0, 9, 500), np.ones(500)]).astype(np.int64)
    rows = rows[:, np.lexsort(rows[3::-1])]

    def settled(size, held):
        monkeypatch.setattr(repeats, "HELD", held)
        batches = [repeats._batch(repeats.FIRST, rows[:, i:i + size]) for i in range(0, 500, size)]
        found = pa.Table.from_batches(repeats._settle(20)(iter(batches))).to_pandas()
        return sorted(map(tuple, found[found.kind != 0].drop(columns="kind").values)), sorted(map(tuple, found[found.kind == 0].values))

    whole, small = settled(500, 1 << 17), settled(7, 10)
    assert whole == small


def test_repeats_hard_rows(spark, hard, empty):
    rows = repeats.without_repeats(hard, ["doc_id", "source"], with_text=True).collect()
    assert len(rows) == hard.count()
    got = {r.doc_id: r for r in rows}
    assert got[1].n_removed > 0 and got[7].kept_text == "" and got[2].n_bytes == 0 and got[9].n_removed == 0
    assert got[5].n_removed == 299 and got[5].kept_text == "x"
    assert repeats.without_repeats(empty, ["doc_id"]).count() == 0


@pytest.mark.parametrize("crowd", [4096, 3])
def test_repeats_of_texts_that_share_an_id(spark, crowd):
    """Cuts of one text do not reach another text of its id; a passage at one place in two of them goes from one."""
    common = "".join(random.Random(3).choices("abcdefgh", k=150))
    texts = [(None, "z" * 250), (None, "no id here"), (None, common + "A"), (None, common + "B"), (3, "y" * 260), (3, "unlike " * 3 + "q")]
    table = spark.createDataFrame(texts + texts[4:5], "doc_id long, text string")
    rows = repeats.without_repeats(table, ["doc_id"], with_text=True, crowd=crowd).collect()
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in rows)
    assert got == [(0, 10, 0), (0, 151, 0), (0, 151, 150), (0, 250, 249), (3, 22, 0), (3, 260, 259), (3, 260, 259)]
    assert {"no id here", "z"} <= {r.kept_text for r in rows}


def test_mixture_of_rows_that_share_an_id(spark, sf):
    """Every row of an id stands as often as the mix takes that row."""
    import corpus_pipeline

    rows = [(None, f"w{i} " * (5 + 7 * i), "en", "ab"[i % 2], 0) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mix(table, row_key=F.xxhash64(*table.columns)).where("size > 0").collect()
    expected = {r.size: round(r.taken / r.size) for r in mixed}
    assert len(expected) == 40 and len(set(expected.values())) > 1
    got = Counter(len(r.text.split()) for r in corpus_pipeline.mix_sources(spark, table, sf).collect())
    assert all(got[n] == c for n, c in expected.items())


def test_mix(spark, hard, empty):
    rows = mixing.mix(hard).collect()
    assert len(rows) == hard.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(hard.repartition(7)).collect()), key=str)
    assert mixing.mix(empty).count() == 0
    assert {r.taken for r in mixing.mix(hard.where("text is null")).collect()} == {0}


def test_mix_near_targets_with_many_shards(spark, sf):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix(docs, shard_size=700, block=8).join(docs.select("doc_id", "source"), "doc_id")
    for r in mixed.groupBy("source").agg({"taken": "sum", "target": "max", "size": "sum", "source_size": "max"}).collect():
        assert r["sum(size)"] == r["max(source_size)"] and abs(r["sum(taken)"] - r["max(target)"]) <= 0.05 * r["max(target)"]


def test_apportion_is_highest_quotients(spark):
    rng = random.Random(4)
    for seats in (0, 1, 7, 100):
        claims = [rng.choice([0, 1, 5, 5, 40, 300]) for _ in range(12)]
        table = spark.createDataFrame([(i, c, seats) for i, c in enumerate(claims)], "p int, claim long, seats long")
        got = {r.p: r.q for r in mixing.apportion(table, [], ["p"], "claim", "seats", "q").collect()}
        bids = sorted(((-c / (2 * k - 1), i) for i, c in enumerate(claims) if c for k in range(1, seats + 1)))[:seats]
        assert got == {i: sum(b[1] == i for b in bids) for i in range(12)}


def test_targets_fill_up(spark):
    table = spark.createDataFrame([(0, 10, 5.0), (1, 100, 2.0), (2, 100, 1.0), (3, 0, 5.0)], "rank int, source_size long, weight double")
    got = {r["rank"]: r.target for r in mixing.with_targets(table, 1.5, 2).collect()}
    assert got[0] == 20 and got[3] == 0 and got[1] == pytest.approx(295 * 2 / 3) and got[2] == pytest.approx(295 / 3)


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(5)
    clean = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(900):
        words, toxic = rng.choices(clean, k=30), int(rng.random() < 0.2)
        if toxic:
            words[rng.randrange(30)] = rng.choice(["vileness", "vilely", "grossly"])
        docs.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, toxic))
    truth = dict(labels)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.score(table, toxicity.fit(table, marks), ["doc_id"]).withColumn("out", toxicity.held_out(toxicity.F.col("doc_id"))).collect()
    held = [(r.score >= 0.5) == bool(truth[r.doc_id]) for r in scored if r.out and r.doc_id in truth]
    assert len(held) > 50 and sum(held) / len(held) > 0.97
    wrong = marks.withColumn("toxic", toxicity.F.when(toxicity.held_out(marks.doc_id), 1 - marks.toxic).otherwise(marks.toxic))
    again = toxicity.score(table, toxicity.fit(table, wrong), ["doc_id"]).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in scored}


def test_toxicity_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None), (6, 0), (6, 0)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0)):
        rows = toxicity.score(hard, toxicity.fit(hard, marks), ["doc_id", "text"]).collect()
        assert len(rows) == hard.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, toxicity.fit(empty, labels), ["doc_id"]).count() == 0
