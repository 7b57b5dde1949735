"""The n-gram join against brute force, its guarantee on random prefixes, and hard rows."""
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from rows import empty, hard  # noqa: F401
from test_documents import brute_components, shingle_set

from itembank.llm import ngram_join as j


def variants(rng, n, words=120, most=8):
    """Texts that differ from one base in up to ``most`` words, so that links at 0.9 are many, but not all."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for at in rng.sample(range(words), rng.randint(0, most)):
            text[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


def corpus(seed=4):
    """Near copies in large and small groups, boilerplate that unrelated texts share, texts of a few words, copies."""
    rng = random.Random(seed)
    texts = variants(rng, 120) + variants(rng, 30, 12, 1) + variants(rng, 6, 400, 20)
    boiler = " ".join(f"b{i}" for i in range(200))
    texts += [f"{boiler} {' '.join(f'u{rng.randrange(10**6)}' for _ in range(rng.randint(0, 30)))}" for _ in range(60)]
    texts += [" ".join(rng.choices("abc", k=rng.randint(1, 14))) for _ in range(60)]
    texts += texts[:20] + [texts[0]] * 30
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("width, percent", [(3, 90), (2, 80)])
def test_components_equal_brute_force(spark, width, percent):
    docs = corpus()
    expected, sets = brute_components(docs, width, percent)
    rows = j.jaccard_components(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), width, percent).collect()
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(s) for i, s in sets.items()}
    assert len({*expected.values()}) < len(docs) - 60


@pytest.mark.parametrize("percent", [90, 80, 60])
def test_similar_sets_share_a_combination(percent, monkeypatch):
    """Whatever the tokens' classes, two sets that are similar enough have a combination in common."""
    monkeypatch.setattr(j, "CLASSES", (5, 50))
    rng = np.random.default_rng(percent)
    shared = 0
    for turn in range(3000):
        n = int(rng.integers(1, 400)) if turn % 2 else int(rng.integers(1, 30))
        tokens = np.sort(rng.choice(1 << 62, 3 * n + 60, replace=False).astype(np.uint64))
        counts = rng.choice([1, 2, 10, 100], len(tokens), p=rng.dirichlet([0.5] * 4))
        x = rng.choice(len(tokens), n, replace=False)
        gone, new = int(rng.integers(0, 1 + n * (100 - percent) // 100)), int(rng.integers(0, 1 + n * (100 - percent) // 100))
        y = np.concatenate([x[gone:], np.setdiff1d(np.arange(len(tokens)), x)[:new]])
        x, y = np.sort(x), np.sort(y)
        both = len(np.intersect1d(x, y))
        if not both or 100 * both < percent * (len(x) + len(y) - both) or len(x) == len(y) == both:
            continue
        assert min(len(x), len(y)) >= j.least_size(percent)
        prefixes = [s[:j.prefix_size(len(s), percent)] for s in (x, y)]
        made = [j.combinations(tokens[p], counts[p], len(s), percent) for p, s in zip(prefixes, (x, y))]
        # A token that two prefixes hold has a count of two at least; where the random count is 1 it stands for itself.
        alone = np.intersect1d(*prefixes)
        assert len(np.intersect1d(*made)) or (counts[alone] == 1).any()
        assert j.may_be_similar(tokens[prefixes[0]], len(x), tokens[prefixes[1]], len(y), percent)
        shared += 1
    assert shared > 300


def test_hard_rows(spark, hard, empty):
    rows = j.jaccard_components(hard).collect()
    assert len(rows) == hard.count()
    texts = {(r.doc_id, len(shingle_set(r.text, 3))) for r in hard.collect()}
    assert {(r.doc_id, r.n_shingles) for r in rows} == texts
    same = {1: 1, 7: 1, 10: 1}
    assert {r.doc_id: r.component_id for r in rows} == {r.doc_id: same.get(r.doc_id, r.doc_id) for r in rows}
    assert j.jaccard_components(empty).count() == 0


def test_texts_of_one_id_are_one_document(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (11, c), (None, a), (None, a)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in j.jaccard_components(rows).collect()), key=str)
    assert got == sorted([(3, 3), (5, 3), (5, 3), (9, 3), (11, 11), (None, None), (None, None)], key=str)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    expected, _ = brute_components({r.doc_id: r.text for r in docs.collect()}, 3, 90)
    assert {r.doc_id: r.component_id for r in j.op13_ngram_join(spark, sf).collect()} == expected


def test_prefixes_hold_enough():
    for percent in (50, 80, 90, 95):
        for n in range(1, 3000, 7):
            assert j.errors(n, percent) + 1 <= j.prefix_size(n, percent) <= n
            for size_class in j.size_classes(n, percent):
                dealt = j.groups(size_class, percent)
                assert not dealt or j.prefix_size(n, percent) >= j.errors(n, percent) + 1 + 3 * dealt


def test_leading_bits_bound_what_is_shared():
    """Never below the truth, whichever tokens agree in their leading 32 bits; equal to the bound of whole tokens where none do."""
    rng = np.random.default_rng(5)
    for turn in range(200):
        spread = 40 if turn % 2 else 1 << 31
        def sets(count):
            tokens = [rng.integers(0, spread, 60).astype(np.uint64) << np.uint64(32) | rng.integers(0, 4, 60).astype(np.uint64) for _ in range(count)]
            return [np.unique(x[:rng.integers(1, 60)]) for x in tokens]
        left, right = sets(4), sets(3)
        right += [np.unique(np.concatenate([left[0], right[0][:3]]))]
        begun = [[np.sort(j.ahead(s, int(rng.integers(1, len(s) + 1)))) for s in side] for side in (left, right)]
        sizes = [np.array([len(s) for s in side]) for side in (left, right)]
        short = [[(s >> np.uint64(32)).astype("<u4") for s in side] for side in begun]
        most = j.most_shared(short[0], sizes[0], short[1], sizes[1])
        true = np.array([[len(np.intersect1d(x, y)) for y in right] for x in left])
        assert (most >= true).all()
        if spread > 40:
            assert (most == j.most_shared(begun[0], sizes[0], begun[1], sizes[1])).all()


def test_join_drops_what_was_not_asked_for(spark):
    """A marked table keeps every row that is asked for, null keys apart, and few others."""
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(-500, 20_000)] + [(None, "none"), (7, None)], "doc_id long, text string")
    wanted = spark.createDataFrame([(i,) for i in (-500, -3, 7, 19_999, 40_000)], "doc_id long")
    def told(batches):
        for batch in batches:
            yield batch.select(["doc_id", "text"])

    got = j.marked(rows, "doc_id", wanted, told, rows.schema).collect()
    assert {(r.doc_id, r.text) for r in got} >= {(-500, "t-500"), (-3, "t-3"), (7, "t7"), (7, None), (19_999, "t19999")}
    assert len(got) < 10 and j.marked(rows, "doc_id", wanted.limit(0), told, rows.schema).count() == 0


def test_texts_and_prefixes_are_cut_down_before_they_are_joined(spark, monkeypatch):
    """Of 400 texts only those of candidate pairs are shuffled to the pairs, each prefix of a large bucket once to each."""
    rng = random.Random(3)
    docs = {i: " ".join(f"v{rng.randrange(10**6)}" for _ in range(50)) for i in range(400)} | dict(enumerate(variants(rng, 40), 1000))
    seen, marked = [], j.marked
    monkeypatch.setattr(j, "marked", lambda rows, key, wanted, *then: seen.append((key, out := marked(rows, key, wanted, *then), wanted)) or out)
    got = j.jaccard_components(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_components(docs, 3, 90)[0]
    kept = [(key, out.count(), wanted.distinct().count()) for key, out, wanted in seen]
    assert [k for k, *_ in kept] == ["doc_id", "node", "doc_id", "node", "doc_id"] and all(n <= m + 2 <= 42 for _, n, m in kept)


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_sets_of_many_texts_at_once(width):
    """Words of a batch that are hashed together give the sets that each text has alone, whatever stands beside it."""
    rng = random.Random(width)
    pieces = ["a", "A", "b", "ab", "é", "É", "x" * 7, "x" * 8, "x" * 9, "y" * 64, "y" * 65, "y" * 66, "z" * 300, " ", "\x00", "\x1c"]
    texts = [None, "", " ", "\t\n\x0b\x0c\r", "a", "A b", "a\x00", "a b c", "x" * 2000]
    texts += ["".join(rng.choice(pieces) + rng.choice([" ", "  ", "\n", ""]) for _ in range(rng.randrange(12))) for _ in range(300)]
    want = [shingle_set(t, width) for t in texts]
    column = pa.array(["left out", *texts, "left out"]).slice(1, len(texts))
    got = j.shingle_sets(column, width)
    assert [len(s) for s in got] == [len(s) for s in want] and all((s[1:] > s[:-1]).all() for s in got)
    for (x, a), (y, b) in itertools.combinations(zip(got[:120], want), 2):
        assert len(np.intersect1d(x, y)) == len(a & b)
    assert len(np.unique(np.concatenate(got))) == len(set().union(*want)) and j.shingle_sets(column.slice(0, 0), width) == []


def test_second_search_takes_buckets_with_untold_pairs(spark, monkeypatch):
    """A bucket where each member told all its pairs is not searched again; with few pairs a member told first, the second search finds the rest."""
    rng = random.Random(11)
    docs = {}
    for family in range(4):
        docs |= dict(enumerate(variants(rng, 30), 1000 * family))
    expected, _ = brute_components(docs, 3, 90)
    rows, staged, kept = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), j.stage, {}

    def counted(df, folder, name):
        kept[name] = out = staged(df, folder, name)
        return out

    monkeypatch.setattr(j, "stage", counted)
    for best in (j.BEST, 1):
        monkeypatch.setattr(j, "BEST", best)
        assert {r.doc_id: r.component_id for r in j.jaccard_components(rows).collect()} == expected
        cut = kept["near-met"].where("bucket IS NOT NULL").select("bucket").distinct()
        again = kept["all-held"].select("bucket").distinct()
        assert sorted(cut.collect()) == sorted(again.collect())
        assert again.count() < kept["near-held"].select("bucket").distinct().count()
