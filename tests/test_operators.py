import random

import pytest
from pyspark.sql import functions as F

from itembank.functions import query as qy
from itembank.operators import batches as bt
from itembank.operators import clean as cl
from itembank.operators import dedupe as dd
from itembank.operators import documents as dc
from itembank.operators import ingest as ing
from itembank.operators import link as lk
from itembank.operators import quota
from itembank.operators import report as rp
from itembank.operators import review as rv
from itembank.operators import select as sel
from itembank.operators.ordered import row_numbers, running_sum, stored_ranges
from itembank.operators.skew import attach_per_key

BANK = "pos long, stem string, options array<string>, answer string, review_flags array<string>"


def bank(spark, rows):
    full = [(i, s, o, a, f) for i, (s, o, a, f) in enumerate(rows)]
    b = spark.createDataFrame(full, BANK)
    return b.withColumn("remark", F.lit("")).withColumn("image", F.lit("")).withColumn("category_tags", F.array(F.lit("t")))


def test_row_numbers_and_sums_across_buckets(spark):
    rows = [(k, p, p * 3 % 7) for k in ("a", None) for p in random.Random(1).sample(range(1000), 120)]
    df = spark.createDataFrame(rows, "k string, pos long, x long")
    got = row_numbers(df, ["k"], "pos", width=37, total="n").collect()
    for k in ("a", None):
        mine = sorted((r["pos"], r["rn"]) for r in got if r["k"] == k)
        assert [rn for _, rn in mine] == list(range(1, 121))
    assert {r["n"] for r in got} == {120}
    sums = running_sum(df, ["k"], "pos", "x", "before", width=37).filter("k = 'a'").orderBy("pos").collect()
    run = 0
    for r in sums:
        assert r["before"] == run
        run += r["x"]


@pytest.mark.parametrize("hot", [1, 1000])
def test_attach_per_key_modes(spark, hot):
    rows = spark.createDataFrame([(i, "h" if i % 3 == 0 else (None if i % 7 == 0 else f"k{i % 5}")) for i in range(200)], "pos long, k string")
    stats = rows.filter("k IS NULL OR k <> 'k1'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    want = {r["k"]: (r["n"], r["first"]) for r in stats.collect()}
    out = attach_per_key(rows, stats, ["k"], "n", hot_keys=hot).collect()
    assert len(out) == 200
    assert all((r["n"], r["first"]) == want.get(r["k"], (None, None)) for r in out)
    assert attach_per_key(rows, stats, ["k"], "n", how="anti", hot_keys=hot).count() == rows.filter("k = 'k1'").count()
    assert attach_per_key(rows, stats, ["k"], how="semi", hot_keys=hot).count() == rows.filter("k IS NULL OR k <> 'k1'").count()


def test_clean_example(spark):
    b = bank(spark, [("甲题", [], "", []), ("乙题", ["A.一"], "A", []), ("乙 题", [], "A", []), ("丙题", [], "A", []), ("丙题", [], "B", []), ("丁题", [], "B", [])])
    kept, removed, report = cl.clean(b)
    assert report.first().asDict() == {"before": 6, "after": 2, "removed": 4, "normalized": 1, "missing_answer": 1, "answer_conflict": 2, "duplicate_stem": 1}
    assert sorted((r["stem"], tuple(r["options"])) for r in kept.collect()) == [("丁题", ()), ("乙题", ("一",))]
    assert {r["pos"]: r["reasons"] for r in removed.collect()} == {0: ["missing_answer"], 2: ["duplicate_stem"], 3: ["answer_conflict"], 4: ["answer_conflict"]}
    assert cl.clean(b, ["missing_answer"])[0].count() == 5
    # Without the conflict rule its rows are first and later copies.
    assert {r["pos"] for r in cl.clean(b, ["duplicate_stem"])[1].collect()} == {2, 4}
    for bad in ([], ["x"], "missing_answer"):
        with pytest.raises(ValueError):
            cl.clean(b, bad)


def test_case_is_kept_when_cleaning_but_not_when_deduplicating(spark):
    b = bank(spark, [("B 基因", [], "A", []), ("b 基因", [], "A", [])])
    assert cl.clean(b)[1].count() == 0
    assert dd.exact_duplicates(b).count() == 2


def test_blank_keys_group_only_in_compat(spark):
    b = bank(spark, [("，", [], "", []), ("。", [], "", [])])
    assert dd.exact_duplicates(b).count() == 0 and dd.exact_duplicates(b, compat=True).count() == 2


def test_queries(spark):
    with pytest.raises(ValueError):
        qy.compile_query({"keywords": []}, strict=True)
    with pytest.raises(ValueError):
        qy.compile_query({"op": "NOT", "keywords": ["a"]}, strict=True)
    deep = {"keywords": ["a"]}
    for _ in range(9):
        deep = {"clauses": [deep]}
    with pytest.raises(ValueError):
        qy.compile_query(deep, strict=True)
    assert qy.compile_query({"op": "xor", "keywords": "a, b"}) == [qy.Clause(-1, 0, False, ("a", "b"))]
    nested = qy.compile_query({"op": "and", "keywords": ["x"], "clauses": [["y", "z"], {"keywords": []}]})
    assert nested[:2] == [qy.Clause(-1, 0, True, ("x",)), qy.Clause(0, 1, False, ("y", "z"))]
    texts = spark.createDataFrame([("x y",), ("x",), ("z",), ("x z",)], "t string")
    assert [r.t for r in texts.where(qy.matches(nested, "t")).collect()] == ["x y", "x z"]
    assert texts.where(qy.matches(qy.compile_query({}), "t")).count() == 4
    assert qy.search_tokens("color|x") == (["color", "x"], "OR")
    assert qy.search_tokens("color|x", compat=True) == (["col", "x"], "OR")
    assert qy.search_tokens("A b，c") == (["a", "b", "c"], "AND")


def test_quota_gives_later_groups_what_is_left(spark):
    b = bank(spark, [("细胞 一", [], "", []), ("细胞 二", [], "", []), ("遗传 细胞", [], "", []), ("遗传", [], "", []), ("3.遗传 排除", [], "", [])])
    groups = [{"count": 2, "query": {"keywords": ["细胞"]}}, {"count": 3, "query": {"keywords": ["遗传", "细胞"]}, "exclude_keywords": ["排除"]}]
    picked, report = sel.quota_select(b, groups)
    assert sorted((r["pos"], r["sel_group"]) for r in picked.collect()) == [(0, 0), (1, 0), (2, 1), (3, 1)]
    rep = {r["sel_group"]: r.asDict() for r in report.collect()}
    assert rep[0]["matched"] == 3 and rep[1] == {"sel_group": 1, "requested": 3, "matched": 2, "selected": 2, "shortfall": 1}
    with pytest.raises(ValueError):
        sel.quota_select(b, [{"count": 501, "query": {"keywords": ["a"]}}])
    many, _ = sel.quota_select(b, [{"count": 501, "query": {"keywords": ["细胞"]}}] * 31, max_groups=None, max_count=None)
    assert sorted((r["pos"], r["sel_group"]) for r in many.collect()) == [(0, 0), (1, 0), (2, 0)]


def by_hand(rows, counts):
    used, out = set(), []
    for g, n in enumerate(counts):
        mine = [p for _, p, groups in sorted(rows) if g in groups and p not in used][:n]
        used.update(mine)
        out += [(p, g, i + 1) for i, p in enumerate(mine)]
    return sorted(out)


@pytest.mark.parametrize("counts, range_rows", [
    ([3, 9, 1, 40, 7], 8), ([1, 1, 1, 1, 1], 8), ([500] * 5, 16), ([60, 2, 300, 5, 60], 1000), ([2] * 40, 5)])
def test_greedy_quotas_over_ranges_equal_the_greedy_order(spark, counts, range_rows):
    """Groups run out in different ranges, in the same one, or never; most rows are asked for by one group."""
    pick = random.Random(len(counts) * range_rows)
    rows = [(pick.randrange(6), p, sorted({0, *pick.sample(range(len(counts)), pick.randrange(3))} - ({0} if p % 3 else set()))) for p in range(120)]
    member = spark.createDataFrame(rows, "ord int, pos long, groups array<int>")
    got = quota.greedy_quotas(member, counts, ["ord", "pos"], range_rows)
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, counts)


def test_quotas_of_nothing(spark):
    member = spark.createDataFrame([(1, [])], "pos long, groups array<int>")
    assert quota.greedy_quotas(member, [2], ["pos"]).collect() == []
    assert quota.greedy_quotas(member.limit(0), [2], ["pos"]).collect() == []


def test_every_bank_row_needs_a_score(spark):
    b = bank(spark, [("a", [], "", []), ("b", [], "", []), ("c", [], "", [])])
    scores = spark.createDataFrame([(0, 0.5, [0], "fits"), (2, None, [0], "fits")], "pos long, score double, groups array<int>, reason string")
    assert sorted((r["pos"], r["error"]) for r in sel.score_errors(scores, b, 1).collect()) == [(1, "no score"), (2, "score")]
    picked, _ = sel.score_quota_select(b, scores, [{"count": 3}])
    assert [r["pos"] for r in picked.collect()] == [0]


def test_export_waits_for_review(spark):
    rows = spark.createDataFrame([(1, ("accepted",)), (2, ("rejected",)), (3, ("pending",))], "pos long, selection_review struct<status:string>")
    assert [r["pos"] for r in sel.export_filter(rows.filter("pos < 3")).collect()] == [1]
    with pytest.raises(Exception, match="review every"):
        sel.export_filter(rows).collect()


ITEM = "pos long, kind string, grp string, section string, number string, answer string, explanation string, source_file string, source_pages array<int>, complete boolean"


def test_match_solutions(spark):
    q = [(1, "1", "", ""), (2, "2", "", "T"), (3, "3", "", ""), (4, "3", "", ""), (5, "4", "S", ""), (6, "5", "", ""), (7, "", "", "")]
    s = [(11, "1", "", "ｔｆ"), (12, "2", "", "F"), (13, "3", "", "A"), (14, "4", "", "B"), (15, "5", "", "A"), (16, "5", "", "B"), (17, "", "", "C")]
    make = lambda rows, kind: spark.createDataFrame([(p, kind, "g", sec, n, a, "why", "f", [1], p != 14) for p, n, sec, a in rows], ITEM)
    got = {r["pos"]: r for r in lk.match_solutions(make(q, "question"), make(s, "solution")).collect()}
    assert got[1]["answer"] == "TF" and got[1]["match_method"] == "exact"
    assert got[2]["answer"] == "F" and got[2]["replaced_answer"] == "T"
    assert got[3]["link_flags"] == [lk.FLAG_DUPLICATE_NUMBER, lk.FLAG_AMBIGUOUS] and got[3]["solution_pos"] is None
    assert got[5]["solution_pos"] == 14 and got[5]["match_method"] == "unique_number_in_linked_paper" and got[5]["link_flags"] == [lk.FLAG_INCOMPLETE_SOLUTION]
    assert got[6]["link_flags"] == [lk.FLAG_AMBIGUOUS] and got[7]["link_flags"] == []


def test_pack_lines(spark):
    df = spark.createDataFrame([(1, ["abcd", "efgh", "x", " "]), (2, ["  "]), (3, [])], "doc_id long, lines array<string>")
    got = sorted((r["doc_id"], r["page"], r["text"]) for r in dc.pack_lines(df, size=10).collect())
    assert got == [(1, 1, "abcd\nefgh\n"), (1, 2, "x\n \n")]
    with_image = df.filter("doc_id = 2").withColumn("imgs", F.array(F.array(F.lit("i.png"))))
    assert [(r["text"], r["images"]) for r in dc.pack_lines(with_image, images="imgs").collect()] == [("  \n", ["i.png"])]


def test_infer_segments_needs_a_closed_gap(spark):
    rows = [("a", 1, "questions"), ("a", 2, "solutions"), ("b", 1, "questions"), ("b", 2, "blank"), ("b", 3, "solutions"),
            ("c", 1, "questions"), ("c", 2, "unknown"), ("c", 3, "solutions"), ("d", 1, "solutions"), ("d", 2, "questions"), ("e", 1, "questions")]
    got = {r["doc"]: (r["segment_status"], [tuple(s) for s in r["segments"] or []]) for r in dc.infer_segments(spark.createDataFrame(rows, "doc string, page long, role string")).collect()}
    assert got["a"] == ("boundary_checked", [("questions", 1, 1), ("solutions", 2, 2)])
    assert got["b"] == ("boundary_checked", [("questions", 1, 2), ("solutions", 3, 3)])
    assert got["c"][0] == got["d"][0] == "needs_review" and got["e"] == ("sampled", [("questions", 1, 1)])


def test_link_documents(spark):
    rows = [("q1", "questions", "期中 卷", 30), ("s1", "solutions", "期中卷（答案）", 30), ("q2", "questions", "期末", 40), ("q3", "questions", "期末", 41),
            ("s2", "solutions", "期末 解析", 40), ("m", "mixed", "x", 5), ("q4", "questions", "期中卷二", 30), ("q5", "questions", "答案", 30), ("s5", "solutions", "解析", 30)]
    got = {r["id"]: r for r in dc.link_documents(spark.createDataFrame(rows, "id string, role string, title string, last_question_number int")).collect()}
    assert got["q1"]["related_id"] == "s1" and got["s1"]["paper_id"] == "q1" and got["s1"]["relationship_status"] == "matched"
    assert got["q2"]["relationship_status"] == "needs_review" and got["q3"]["relationship_status"] == "unpaired"
    assert got["m"]["relationship_status"] == "self_contained" and got["q4"]["relationship_status"] == "unpaired" and got["q5"]["relationship_status"] == "unpaired"


def _reads(spark, rows):
    return spark.createDataFrame(
        [(p, pg, c, vw, "1", "1", 2, ch, ok, dup) for p, pg, c, vw, ch, ok, dup in rows],
        "pos long, page int, crop string, view string, number string, asked string, n_options int, characters string, complete boolean, duplicated boolean",
    )


def test_consensus_bands_pages_and_errors(spark):
    pair = lambda p, pg, c, a, b, dup=False: [(p, pg, c, "raw", a, True, dup), (p, pg, c, "contrast", b, True, dup)]
    rows = (
        pair(1, 1, "line", "TF", "TF") + pair(2, 1, "line", "TF", "TT") + pair(3, 1, "line", "T?", "TFT") + pair(3, 1, "band_0", "FF", "FF")
        + pair(4, 1, "band_0", "FF", "FF") + pair(4, 1, "band_1", "TF", "??") + pair(5, 1, "line", "TF", "TF") + pair(5, 2, "line", "FF", "FF")
        + pair(6, 1, "line", "TF", "TF") + pair(7, 1, "line", "TF", "TF", True) + pair(8, 1, "line", "TF", "??") + pair(8, 1, "band_2", "TF", "TF")
        + pair(9, 1, "line", "FT", "??") + pair(9, 1, "band_2", "TF", "TF")
    )
    q = spark.createDataFrame([(i, "TT", [rv.FLAG_AUDIT_DIFFERS, "other"]) for i in range(1, 11)], "pos long, answer string, review_flags array<string>")
    errors = spark.createDataFrame([(6,)], "pos long")
    got = {r["pos"]: (r["answer"], r["zoom_confirmed"]) for r in rv.answer_consensus(q, _reads(spark, rows), errors).collect()}
    assert {p for p, (_, ok) in got.items() if ok} == {1, 3, 8}
    assert got[1][0] == "TF" and got[3][0] == "FF" and got[2][0] == "TT"


def test_decisions_are_checked_against_the_current_row(spark):
    q = spark.createDataFrame(
        [(1, "s", ["a"], "A", "", None, None, False, ["f"], "t1"), (2, "s", ["a"], "", "", None, None, False, ["f"], "t2"),
         (3, "s", ["a"], "A", "", None, None, True, ["f"], "t3"), (4, "s <uncertain>", ["a"], "A", "", None, None, False, ["f"], "t4"), (5, "s", [], "A", "", None, None, False, ["f"], "t5")],
        "pos long, stem string, options array<string>, answer string, explanation string, status string, figure_status string, suspected boolean, review_flags array<string>, identity string",
    )
    d = spark.createDataFrame([(p, f"t{p}" if p != 5 else "old", "accepted", p) for p in range(1, 6)] + [(9, "t9", "accepted", 1)], "pos long, token string, decision string, s long")
    out, history, bad = rv.apply_question_decisions(q, d.select("pos", "token", "decision", F.timestamp_seconds("s").alias("ts")))
    rows = {r["pos"]: r for r in out.collect()}
    assert rows[1]["status"] == "accepted" and rows[1]["review_flags"] == [] and rows[1]["decisions"] == 1
    assert [(r["pos"], r["previous_status"], r["previous_flags"]) for r in history.collect()] == [(1, None, ["f"])]
    assert {r["pos"]: r["reason"] for r in bad.collect()} == {2: "no answer", 3: "figure not confirmed", 4: "uncertain text", 5: "stale", 9: "unknown row"}


def test_ingest_is_gated_and_idempotent(spark):
    cols = "pos long, number string, stem string, options array<string>, answer string, status string, figure_status string, suspected boolean, review_flags array<string>"
    rows = [(1, "1", "1.题", ["A.甲"], "A", None, None, False, []), (2, None, "题", ["甲"], "A", None, None, False, []), (3, None, "x", [], "", None, None, False, []),
            (4, None, "y", [], "A", "discarded", None, False, []), (5, None, "z", [], "A", None, None, True, []), (6, None, "正误", ["a"], "TF", None, None, False, []), (7, None, "w", [], "A", None, "confirmed", True, [])]
    result = spark.createDataFrame(rows, cols)
    plan = ing.ingest_plan(result.limit(0), result)
    assert {r["pos"]: r["outcome"] for r in plan.collect()} == {1: "added", 2: "duplicates", 3: "missing_answer", 4: "discarded", 5: "pending_review", 6: "pending_review", 7: "added"}
    again = ing.ingest_plan(plan.filter("outcome = 'added'").drop("outcome", "fingerprint"), result)
    assert again.filter("outcome = 'added'").count() == 0
    with pytest.raises(ValueError):
        ing.ingest_plan(result, result, partial=True)


def test_share_figures_needs_review(spark):
    kind = "array<struct<page:int,bbox:array<double>,shared_with:array<string>,sharing_reviewed:boolean,shared_from:string>>"
    fig = lambda ok, src=None: (1, [1.0], ["2", "3"], ok, src)
    rows = [(1, "h", "", "1", [fig(True)]), (2, "h", "", "2", []), (3, "h", "X", "3", []), (4, "h", "Y", "1", [fig(False)]), (5, "h", "Y", "2", []), (6, "k", "", "2", [])]
    q = spark.createDataFrame(rows, f"pos long, source_hash string, section string, number string, figures {kind}")
    got = {r["pos"]: r for r in lk.share_figures(q).collect()}
    assert got[2]["figures"][0]["shared_from"] == "1" and [len(got[i]["figures"]) for i in (1, 3, 5, 6)] == [1, 0, 0, 0]
    assert got[4]["sharing_unreviewed"] and not got[1]["sharing_unreviewed"]
    # Shared figures are not passed on.
    assert lk.share_figures(lk.share_figures(q).drop("sharing_unreviewed")).filter("pos = 2").first()["figures"] == got[2]["figures"]


def test_coverage_worklist_neighbours(spark):
    rows = [(i, "question", "d", str(n), [p]) for i, (n, p) in enumerate([(2, 3), (3, 3), (6, 5), (6, 6), (9, 30)])]
    items = spark.createDataFrame(rows, "pos long, kind string, source_file string, number string, source_pages array<int>")
    docs = spark.createDataFrame([("d", "questions", 8, True, 40)], "id string, role string, last_question_number int, continuous_numbering boolean, pages int")
    spans = lambda **limits: {(r["n"], r["to_n"]): (r["first_page"], r["last_page"], r["status"]) for r in lk.coverage_worklist(items, docs, **limits).collect()}
    assert spans() == {(1, 1): (3, 3, "ready"), (4, 5): (3, 5, "ready"), (6, 6): (5, 6, "ready"), (7, 8): (5, 30, "ready")}
    assert spans(max_pages=6)[7, 8] == (5, 30, "too_many_pages") and {s for *_, s in spans(max_targets=5).values()} == {"too_many_targets"}
    assert {(r["n"], r["to_n"]): r["problem"] for r in lk.coverage(items, docs).collect()} == {(1, 1): "missing", (4, 5): "missing", (6, 6): "duplicate", (7, 8): "missing"}


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_gaps_equal_number_by_number(spark, monkeypatch, width):
    """Any last number costs rows for the numbers that are there only; spans agree with a search over all rows."""

    from itembank.operators import gaps

    monkeypatch.setattr(gaps, "WIDTH", width)
    rng = random.Random(width)
    rows, last = [], {"a": 60, "b": 25, "c": 9, "d": 40, "e": 5_000_000_000}
    for doc, most in last.items():
        for _ in range(0 if doc == "c" else 14):
            n, page = rng.randint(0, 50), rng.randint(1, 9)
            rows.append((len(rows), "question", doc, str(n), [page, page + rng.randint(0, 2)]))
    raw = [("a", str(n), [20, 21]) for n in range(0, 70, 7)]
    items = spark.createDataFrame(rows, "pos long, kind string, source_file string, number string, source_pages array<int>")
    docs = spark.createDataFrame([(d, "questions", n, True, 30) for d, n in last.items()], "id string, role string, last_question_number long, continuous_numbering boolean, pages int")
    seen = spark.createDataFrame(raw, "source_file string, number string, source_pages array<int>")
    got = lk.missing_worklist(items, docs, seen).collect()
    told = {}
    for r in got:
        for n in range(r["n"], min(r["to_n"], 200) + 1):
            assert told.setdefault((r["source_file"], n), (r["first_page"], r["last_page"], r["status"])) is not None
    expected = {}
    for doc, most in last.items():
        mine = [(int(n), pos, min(p), max(p)) for pos, _, d, n, p in rows if d == doc]
        for n in range(1, min(most, 200) + 1):
            if all(n != m for m, *_ in mine):
                near = [(lo, hi) for _, _, lo, hi in sorted((abs(m - n), pos, lo, hi) for m, pos, lo, hi in mine)[:2]]
                near = [(20, 21)] if doc == "a" and n % 7 == 0 else near
                first, end = (max(1, min(lo for lo, _ in near) - 1), min(30, max(hi for _, hi in near) + 1)) if near else (None, None)
                expected[doc, n] = (first, end, "no_rows" if not near else "no_pages" if end < first else "ready")
    assert told == expected and max(r["to_n"] for r in got) == 5_000_000_000
    assert len(got) < 400


def test_every_valid_decision_counts(spark):
    """A valid decision before a stale one holds; each valid one is told in the history, over hours and at one time."""
    q = spark.createDataFrame([(1, "s", ["a"], "A", "", "pending", None, False, ["f"], "t")],
                              "pos long, stem string, options array<string>, answer string, explanation string, status string, figure_status string, suspected boolean, review_flags array<string>, identity string")
    log = [("t", "discarded", 10), ("t", "accepted", 9000), ("old", "discarded", 9100), ("t", "maybe", 9200), ("t", "pending", 20_000), ("t", "discarded", 20_000), ("old", "accepted", 30_000)]
    d = spark.createDataFrame([(1, t, a, s, i) for i, (t, a, s) in enumerate(log)], "pos long, token string, decision string, s long, event_id long")
    out, history, bad = rv.apply_question_decisions(q, d.select("pos", "token", "decision", F.timestamp_seconds("s").alias("ts"), "event_id"))
    (row,) = out.collect()
    assert (row["status"], row["review_flags"], row["decisions"]) == ("discarded", [], 4)
    told = sorted((r["event_id"], r["decision"], r["previous_status"], r["previous_flags"]) for r in history.collect())
    assert told == [(0, "discarded", "pending", ["f"]), (1, "accepted", "discarded", ["f"]), (4, "pending", "accepted", []), (5, "discarded", "pending", [])]
    assert sorted((r["event_id"], r["reason"]) for r in bad.collect()) == [(2, "stale"), (3, "unknown decision"), (6, "stale")]


@pytest.mark.parametrize("key", ["", None])
def test_attach_per_key_spreads_keys_without_statistics(spark, key):
    """Nine rows of ten share a blank or null key that the statistics lack: no task gets more than its part of them."""
    from pyspark.sql.functions import spark_partition_id

    rows = spark.range(20_000).select(F.col("id").alias("pos"), F.when(F.col("id") % 10 > 0, F.lit(key)).otherwise(F.col("id").cast("string")).alias("k"))
    stats = rows.filter("pos % 10 = 0").groupBy("k").agg(F.min("pos").alias("first"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, value in conf.items():
        spark.conf.set(k, value)
    try:
        for how, n in (("left", 20_000), ("anti", 18_000)):
            out = attach_per_key(rows, stats, ["k"], how=how, hot_keys=10)
            sizes = [r["count"] for r in out.groupBy(spark_partition_id()).count().collect()]
            assert sum(sizes) == n and max(sizes) < 0.6 * n
        assert attach_per_key(rows, stats, ["k"], how="inner", hot_keys=10).count() == 2_000
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


def test_greedy_batches_cross_blocks(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(bt, "BLOCK", 40)
    monkeypatch.setattr(bt, "SPAN", 3)
    sizes = [rng.choice([1, 5, 30, 70, 500]) for _ in range(700)]
    want, held, total = [0], [sizes[0]], 0
    for n in sizes[1:]:
        if len(held) >= 12 or sum(held) + n > 100:
            held, total = [], total + 1
        held.append(n)
        want.append(total)
    rows = spark.createDataFrame([(3 * i, n) for i, n in enumerate(sizes)], "pos long, size long")
    assert [r.batch for r in bt.greedy_batches(rows, F.col("size"), 12, 100).orderBy("pos").collect()] == want
    assert bt.greedy_batches(rows.limit(0), F.col("size"), 12, 100).count() == 0


def test_printed_numbers_meet(spark):
    """Full-width numbers and full stops match plain numbers, and count as present."""
    schema = "pos long, grp string, section string, number string, answer string, explanation string, source_file string, source_pages array<int>, complete boolean"
    q = spark.createDataFrame([(0, "g", "", "１．", "", "", "f", [1], True), (1, "g", "", "２", "", "", "f", [1], True)], schema)
    s = spark.createDataFrame([(10, "g", "", "1", "A", "x", "k", [1], True), (11, "g", None, "2、", "B", "y", "k", [1], True)], schema)
    assert {r.pos: r.answer for r in lk.match_solutions(q, s).collect()} == {0: "A", 1: "B"}
    assert sorted(r.n for r in q.select(lk.int_number("number").alias("n")).collect()) == [1, 2]


def test_a_known_number_keeps_foreign_labels(spark):
    """A label of another number is text; the number may stand in the source record or be the original one."""
    kind = "pos long, number string, agent_source struct<number:string>, original_number string, stem string, options array<string>, answer string, explanation string, category_tags array<string>, remark string"
    rows = [(1, "5", None, None, "999. the cell"), (2, "999", None, None, "999. the cell"), (3, None, ("5",), None, "999. the cell"),
            (4, "", ("",), "999", "999. the cell"), (5, None, None, None, "999. the cell")]
    bank = spark.createDataFrame([(*r, ["a"], "A", "", [], "") for r in rows], kind)
    shown = {1: "999. the cell", 2: "the cell", 3: "999. the cell", 4: "the cell", 5: "the cell"}
    picked, _ = sel.quota_select(bank, [{"query": {"op": "AND", "keywords": ["cell"]}, "count": 9}])
    assert {r["pos"]: r["stem"] for r in picked.collect()} == shown
    assert {r["pos"]: r["stem"] for r in ing.to_bank_rows(bank.withColumn("source_file", F.lit("f")), "run").withColumn("pos", F.col("pos")).collect()} == shown
    lines = {r["no"]: r["text"] for r in rp.paper_rows(bank).filter("part = 0 AND line_no = 0").collect()}
    assert lines == {n: f"{n}. {text}" for n, text in shown.items()}
    prints = {r["pos"]: r["fingerprint"] for r in ing.with_fingerprint(bank).collect()}
    assert prints[1] == prints[3] != prints[2] == prints[4] == prints[5]


def test_consensus_targets(spark):
    """Questions that ask for no T/F sequence, or whose answer is from no PDF, get no flag."""
    q = spark.createDataFrame([(1, "C", "s", None, ("a.pdf",), []), (2, "C", "s", "true_false", ("a.pdf",), []), (3, "TF", "s", None, ("a.txt",), []), (4, "TF", "s", None, ("a.PDF",), ["x"]), (5, "TF", "s", None, None, [])],
                              "pos long, answer string, stem string, answer_format string, answer_source struct<source_file:string>, review_flags array<string>")
    reads = _reads(spark, [(9, 1, "line", "raw", "TF", True, False)])
    assert {r["pos"]: r["review_flags"] for r in rv.answer_consensus(q, reads).collect()} == {1: [], 2: [rv.FLAG_ZOOM], 3: [], 4: ["x", rv.FLAG_ZOOM], 5: []}


@pytest.mark.parametrize("range_rows", [7, 1000])
def test_retention_of_files_of_one_second(spark, range_rows):
    """Nearly all files share a second and many a size: ranges go through the path, the result through brute force."""
    pick = random.Random(3)
    rows = [(f"f{i:03d}", pick.choice([1, 5, 4096, 90000]), 500 if i % 9 else pick.randrange(100)) for i in range(150)]
    total = sum(r[1] for r in rows)
    files = spark.createDataFrame(rows, "path string, size long, mtime long")
    want, before = set(), 0
    for path, size, mtime in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        if total - before > total // 3 or mtime < 40:
            want.add(path)
        before += size
    got = dc.retention(files, total // 3, 40, range_rows)
    assert {r["path"] for r in got.collect()} == want
    assert got.columns == files.columns
    assert dc.retention(files.limit(0), 10, 40, range_rows).collect() == []


def test_stored_ranges_split_a_hot_first_column(spark):
    rows = stored_ranges(spark.range(90).select(F.lit(1).alias("a"), F.col("id").alias("b")), ["a", "b"], 10)
    sizes = [r["n"] for r in rows.groupBy("part_no").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 90 and len(sizes) >= 5 and max(sizes) <= 30
    ordered = [r["b"] for r in rows.orderBy("part_no", "place_no").collect()]
    assert ordered == list(range(90))


def test_gaps_pass_no_frame_once_per_row(spark):
    """A frame from the next row to the last one is gone through anew for every row."""
    items = spark.createDataFrame([], "pos long, kind string, source_file string, number string, source_pages array<int>")
    docs = spark.createDataFrame([], "id string, role string, last_question_number int, continuous_numbering boolean, pages int")
    for spans in (lk.coverage_worklist(items, docs), lk.missing_worklist(items, docs), lk.coverage(items, docs)):
        plan = spans._jdf.queryExecution().analyzed().toString().lower()
        assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_row_numbers_deal_dense_places_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = row_numbers(spark.range(60_000).withColumnRenamed("id", "pos"), [], "pos", "no")
        assert got.filter("no <> pos + 1").isEmpty()
        assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 60_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
