"""Vector searches against brute force; main text of pages; registration; the pipeline."""
import numpy as np
import pytest
from rows import SF, empty, hard  # noqa: F401
from pyspark.sql import functions as F

from itembank.llm import ann, extract, queries, topk

SCHEMA = "vec_id long, embedding array<double>, label int, rid long, score double"


def vectors(spark, n=400, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x[50:90] = x[50]
    rows = [(i, v.tolist(), 0, 7, 1.0) for i, v in enumerate(x)]
    bad = [None, [], [None] * dims, [float("nan")] * dims, [float("inf")] * dims]
    rows += [(n + 50 * i, v, 0, 7, 1.0) for i, v in enumerate(bad)] + [(100, x[100].tolist(), 0, 7, 1.0)]
    return x, spark.createDataFrame(rows, SCHEMA)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_BLOCK", 90)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 3)
    x, table = vectors(spark)
    rows = topk.stage(topk.integers(table), topk.run_folder(spark, "t"), "rows")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(rows, rows.where("vec_id % 50 = 0"), 5).collect()]
    ids, ints = [*range(400), 100], np.floor(256 * np.concatenate([x, x[100:101]])).astype(int)
    expected = []
    for q in range(401):
        if ids[q] % 50 == 0:
            best = sorted((-int(ints[q] @ ints[c]), ids[c]) for c in range(401) if c != q)[:5]
            expected += [(ids[q], n, c, -s) for n, (s, c) in enumerate(best, 1)]
    assert sorted(got) == sorted(expected)


def test_top_k_broadcasts_no_queries(spark, monkeypatch):
    """A copy of the queries for each block of rows does not go through the driver, however small their file is."""
    monkeypatch.setattr(topk, "ROWS_PER_BLOCK", 20)
    _, table = vectors(spark)
    rows = topk.stage(topk.integers(table), topk.run_folder(spark, "t"), "rows")
    found = topk.top_k(rows, rows.where("vec_id % 50 = 0"), 5)
    assert found.count() == 9 * 5
    joins = [x.strip(" +-:") for x in found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).split("\n") if "Join [block" in x]
    assert joins and all(x.startswith("SortMergeJoin") for x in joins)


def test_best_keeps_ties_by_place():
    scores = np.array([1.0, 3, 2, 3, 2, 2, 0, 2, 3, 1, 1, 1, 1, 2])
    found, best = topk.SortedLists.best(np.arange(14)[::-1], scores, 3)
    assert found.tolist() == [5, 10, 12] and best.tolist() == [3, 3, 3]
    found, best = topk.SortedLists.best(np.arange(14)[::-1], scores[::-1], 3)
    assert found.tolist() == [1, 3, 8] and best.tolist() == [3, 3, 3]


@pytest.mark.parametrize("dims", [1, 3, 16])
def test_sorted_lists_stop_early_and_right(dims):
    rng = np.random.default_rng(dims)
    values = rng.integers(-50, 50, (3000, dims)).astype(float)
    lists = topk.SortedLists(values)
    for own in (-1, 0, 17):
        q = values[17] if own == 17 else rng.integers(-5, 5, dims).astype(float)
        found, scores = lists.search(q, 4, own)
        best = sorted((-(v @ q), i) for i, v in enumerate(values) if i != own)[:4]
        assert [(-s, i) for s, i in zip(scores.tolist(), found.tolist())] == best


def test_top_k_of_nothing(spark):
    empty = topk.integers(spark.createDataFrame([], SCHEMA))
    assert topk.top_k(empty, empty, 5).count() == 0


def recall(got, x, asked, k):
    hits = []
    for q in asked:
        scores = x @ x[q]
        scores[q] = -np.inf
        kth = np.sort(scores)[-k]
        hits.append(np.mean([scores[v] >= kth - 1e-9 for v in got[q]]) if len(got[q]) == k else 0)
    return np.mean(hits)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_nearest_recall(spark, spread, monkeypatch):
    """Unit vectors, and vectors of unequal lengths, in several blocks."""
    monkeypatch.setattr(ann, "BLOCK", 300)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= 1 + spread * rng.random((1500, 1))
    table = spark.createDataFrame([(i, v.tolist(), 0, 7, 1.0) for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-9 and r.vec_id != r.query_id
    assert recall(got, x, range(0, 1500, 20), 10) >= 0.9


@pytest.mark.parametrize("kind", ["outlier", "near copies"])
def test_nearest_keeps_fine_differences(spark, kind):
    """One vector a thousand times longer than the others; vectors that differ by less than a byte can tell."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 16))
    if kind == "outlier":
        x[7] *= 1000
    else:
        x[:250] = x[0] * (1 + 1e-4 * rng.normal(size=(250, 1))) + 1e-4 * rng.normal(size=(250, 16))
    table = spark.createDataFrame([(i, v.tolist(), 0, 7, 1.0) for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert recall(got, x, range(0, 500, 20), 10) >= 0.9


def test_search_goes_on_until_nothing_opens(spark, tmp_path):
    """Along a chain of which a round opens one node, the far end is found."""
    table = spark.createDataFrame([(i, [1.0 + i, 0.5], 0, 7, 1.0) for i in range(9)], SCHEMA)
    nodes, members = ann.nodes_of(table, str(tmp_path))
    node = {r.vec_id: r.node for r in members.collect()}
    graph = spark.createDataFrame([(node[i], node[i + 1]) for i in range(8)], "src long, dst long")
    asks = nodes.where(F.col("node") == node[0]).select(F.lit(1).cast("long").alias("rid"), F.col("x").alias("ask"))
    found = ann.search(graph, nodes, asks, spark.createDataFrame([(1, node[0])], "rid long, node long"), str(tmp_path), kept=4, opened=1)
    assert {r.node for r in found.collect()} == {node[i] for i in (5, 6, 7, 8)}


def test_nearest_hard_rows(spark):
    x, table = vectors(spark, 130)
    table = table.union(spark.createDataFrame([(900, [0.0] * 8, 0, 7, 1.0)], SCHEMA))
    rows = ann.nearest(table, F.col("vec_id") % 20 == 0, 5).collect()
    assert {r.query_id for r in rows} == {0, 20, 40, 60, 80, 100, 120}
    assert ann.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_equal_vectors(spark):
    x, table = vectors(spark, 200)
    rows = [r for r in ann.nearest(table, F.col("vec_id") == 60, 5).collect()]
    assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"])] == [50, 51, 52, 53, 54]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><!-- x -->
<article><h1>Head &amp; more</h1><p>One <b>bold</b>   text<br>next<p>Two &lt;2&gt; %d<form>no</form><aside>side</aside>
<section class="comments"><p>reader</p></section></article><footer>&copy; end</footer></body></html>"""


def test_main_text(spark):
    plain = "<html><body><div id='menu'>Menu</div><div><p>Own text %d.</p><p>Read all about it</p></div><div class='footer'>F</div></body></html>"
    rows = [(i, f"http://h.example/{i}", PAGE % i, "x") for i in range(5)] + [(10 + i, f"http://g.example/{i}", plain % i, "x") for i in range(4)]
    rows += [(20, None, PAGE % 9, "x"), (21, "http://h.example/n", None, "x"), (22, "http://h.example/e", "", "x"), (23, "::", "<p>a<p>b", None),
             (None, "http://i.example/", "<article>only <i>one", "x"), (24, "http://i.example/2", "<p>" * 3000 + "deep", "x"), (0, "http://h.example/0", PAGE % 0, "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in extract.extract(table).collect()}
    assert extract.extract(table).count() == len(rows)
    for i in (0, 3):
        assert got[i] == f"Head & more\nOne bold text next\nTwo <2> {i}"
    assert got[20] == "Head & more\nOne bold text next\nTwo <2> 9"
    assert got[12] == "Own text 2."  # what all pages of the host say outside an article is template
    assert (got[21], got[22], got[23], got[None], got[24]) == ("", "", "a\nb", "only one", "deep")
    assert extract.extract(table.limit(0)).count() == 0


def test_large_hosts_are_dealt_over_parts(spark, monkeypatch):
    """Every part of a host meets its template; the pages without a host meet none."""
    plain = "<html><body><p>Same on all</p><p>Own text %d.</p></body></html>"
    rows = [(i, f"http://{'big' if i % 5 else 'less'}.example/{i}" if i % 4 else None, plain % i) for i in range(120)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Own text {i}." if url else f"Same on all\nOwn text {i}." for i, url, _ in rows}
    for pages, hosts in ((7, 1000), (7, 1), (1000, 1000)):
        monkeypatch.setattr(extract, "PART_PAGES", pages)
        monkeypatch.setattr(extract, "HOT_HOSTS", hosts)
        got = extract.extract(table).collect()
        assert len(got) == 120 and {r.page_id: r.text for r in got} == want


def test_classes_of_the_whole_page_drop_nothing():
    for page in ("<html class='no-ads'><body class='has-sidebar'><article><p>Own</p></article><div class='menu'>M</div></body></html>",
                 "<body id='with-menu'><p>Own</p><div class='sidebar'>S</div></body>"):
        assert extract.main_text(page, [], []) == "Own"


@pytest.mark.parametrize("page, text", [
    ("<div id='page' class='no-ads'><article><h1>H</h1><p>Own</p></article></div>", "H\nOwn"),
    ("<div class='layout with-menu'><nav>N</nav><article><p>Own</p></article></div>", "Own"),
    ("<form action='x'><div class='menu'>M</div><article><p>Own</p></article></form>", "Own"),
    ("<nav>N</nav><form><p>Own words</p></form>", "Own words"),
    ("<article class='post share-enabled'><p>Own</p></article>", "Own"),
    ("<div class='widget'><article><h1>H</h1><p>Own</p></article></div><footer>F</footer>", "H\nOwn"),
    ("<article><p>Own</p><div class='related-work'><p>kin</p></div><div class='related-posts'>x</div></article>", "Own\nkin"),
    ("<article><h1>T</h1><p>Own text of some length</p></article><div class='latest'><article><h2>Tease</h2></article></div>", "T\nOwn text of some length"),
    ("<article><p>One</p></article><article><p>Two</p></article>", "One\nTwo"),
    ("<aside><article>Tease</article></aside><div><p>Own</p></div>", "Own"),
    ("<article><p>Own <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p></article>", "Own x=1"),
    ("<p>Own</p><div class='comments'><article class='comment'><p>reader, longer than all the rest</p></article></div>", "Own"),
    ("<article><p>Own</p></article><div class='site-nav-wrap'>N</div>", "Own"),
    ("<p>Own</p><div class='site-nav-wrap'>N</div>", "Own"),
])
def test_names_around_the_content(page, text):
    assert extract.main_text(page, [], []) == text


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "deep", "<p>" * 30_000 + "deep", "<i>" * 50_000 + "deep" + "</b>" * 50_000, "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000 + "deep",
    "<article>" * 20_000 + "deep"])
def test_any_depth(page):
    assert extract.main_text(page, [], []) == "deep"


def test_template_classes(spark):
    table = spark.createDataFrame([(f"h{i % 2}", i, PAGE % i) for i in range(6)], "host string, row long, html string")
    for r in extract.templates(table).collect():
        names = {t.key: t for t in extract.tokens_of(PAGE % 0)}
        known = [names[k] for k in r["keys"] if k in names]
        assert len(known) == len(r["keys"]) and any(t.name == "article" for t in known) and any(t.text == "Site" for t in known)
        assert not any("Two" in t.text for t in known)


def test_slots_decide_between_articles_and_names(spark):
    """An article that never varies is none beside one that does; a name does not make furniture of the slots with most of the
    varying text; a host whose pages are all the same, or a page alone, keeps what its tags say."""
    intro = "<body><article class='intro'><p>Join us, the same text on every page of the host</p></article><article><p>Own %d</p></article></body>"
    named = ("<body><article><h1>Title</h1><div class='social-stories'><p>A story that differs, number %d</p></div><div class='share'>Share %d</div>"
             "<div class='comments'><p>A reader who has much to say, far more than the story of number %d itself</p></div></article></body>")
    wrapped = "<body><div class='menu'>M</div><div class='widget'><p>Own words, %d</p></div></body>"
    rows = [(i, f"http://a.example/{i}", intro % i) for i in range(4)] + [(10 + i, f"http://b.example/{i}", named % (i, i, i)) for i in range(4)]
    rows += [(20 + i, f"http://c.example/{i}", intro % 7) for i in range(3)] + [(30, "http://d.example/", intro % 8), (31, "http://e.example/", named % (8, 8, 8))]
    rows += [(40 + i, f"http://f.example/{i}", wrapped % i) for i in range(3)]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    both = "Join us, the same text on every page of the host\nOwn %d"
    assert [got[i] for i in range(4)] == [f"Own {i}" for i in range(4)]
    assert [got[10 + i] for i in range(4)] == [f"Title\nA story that differs, number {i}" for i in range(4)]
    assert {got[20 + i] for i in range(3)} == {both % 7} and got[30] == both % 8 and got[31] == "Title"
    assert [got[40 + i] for i in range(3)] == [f"Own words, {i}" for i in range(3)]


def test_classes_are_nested():
    assert extract.nested({1: [0, 5, 9], 2: [1, 3], 3: [6, 8]}) == {0: 0, 1: 1, 3: 1, 5: 0, 6: 2, 8: 2, 9: 0}
    # The second class goes on behind a token of the first: another class there.
    assert extract.nested({1: [0, 5, 9], 2: [1, 3, 6, 7]}) == {0: 0, 1: 1, 3: 1, 5: 0, 6: 2, 7: 2, 9: 0}
    assert extract.nested({1: [0, 2], 2: [1, 3]}) == {0: 0, 1: 1, 2: 0, 3: 2} and extract.nested({}) == {}


def test_pages_query(spark, sf):
    rows = extract.op1_main_text(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r.n_chars == len(r.text) > 0 for r in rows)


def test_registered():
    names = sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]


def test_pipeline(spark, sf, hard, empty):
    import corpus_pipeline

    docs = hard.select(*corpus_pipeline.COLUMNS)
    for name, apply in corpus_pipeline.STAGES:
        assert apply(spark, empty.select(*corpus_pipeline.COLUMNS), sf).count() == 0, name
        after = apply(spark, docs, sf)
        if name != "sentencepiece":
            assert after.dtypes == docs.dtypes, name
        after.collect()
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()}
    assert {1, 2, 3, 9, None} <= kept and not {7, 10} & kept
    final = corpus_pipeline.run(spark, sf)
    known = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert final.count() and {r.doc_id for r in final.select("doc_id").collect()} <= known
