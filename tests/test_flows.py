"""Storage, model calls and streams."""
import json
import uuid

import pytest
from pyspark.sql import functions as F

from itembank.operators import infer as inf
from itembank.operators import report as rp
from itembank.plans import catalog_model, curate  # noqa: F401
from itembank.plans.registry import QUERIES
from itembank.sources import bank as bk
from itembank.sources import versions as vs
from itembank.sources import views as v
from itembank.streaming import streams as st


def test_read_bank_checks_stems(spark, tmp_path):
    good, bad, odd = tmp_path / "a.json", tmp_path / "b.json", tmp_path / "c.json"
    good.write_text("﻿" + json.dumps({"questions": [{"stem": "一", "options": ["A"]}, {"stem": "二", "extra": 1}]}), encoding="utf-8")
    bad.write_text(json.dumps([{"stem": 3}]))
    odd.write_text("3")
    rows = bk.read_bank(spark, str(good)).orderBy("pos").collect()
    assert [(r["pos"], r["stem"], r["options"]) for r in rows] == [(0, "一", ["A"]), (1, "二", None)]
    for path in (bad, odd):
        with pytest.raises(Exception):
            bk.read_bank(spark, str(path)).collect()


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("﻿内容", encoding="utf-8")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.exe").write_bytes(b"x")
    rows = {r["suffix"]: r for r in bk.read_documents(spark, [str(tmp_path), str(tmp_path)]).collect()}
    assert set(rows) == {".txt", ".pdf"} and rows[".txt"]["text"] == "内容" and rows[".pdf"]["text"] is None
    with pytest.raises(ValueError):
        bk.read_documents(spark, [])


def test_bundle_is_new_and_whole(spark, tmp_path):
    files = spark.createDataFrame([("i/a.PNG", bytearray(b"1")), ("i/b.png", bytearray(b"1"))], "path string, content binary")
    q = spark.createDataFrame([(0, "s", "i/a.PNG", ["i/b.png", "i/a.PNG"]), (1, "t", "", [])], "pos long, stem string, image string, images array<string>")
    path = str(tmp_path / "out")
    bk.write_bundle(q, files, path)
    row = spark.read.json(f"{path}/questions").filter("pos = 0").first()
    assert row["image"].startswith("images/") and len(row["images"]) == 2 and spark.read.parquet(f"{path}/images").count() == 1
    with pytest.raises(Exception):
        bk.write_bundle(q, files, path)
    with pytest.raises(ValueError, match="missing"):
        bk.write_bundle(q.withColumn("image", F.lit("nope.png")), files, str(tmp_path / "other"))


def test_versions_conflict_and_rollback(spark, tmp_path):
    store = vs.VersionStore(spark, str(tmp_path / "bank"))
    one = spark.createDataFrame([(0, "甲", [], "A", ""), (1, "乙", [], "", "")], "pos long, stem string, options array<string>, answer string, remark string").withColumn(
        "review_flags", F.array().cast("array<string>")
    )
    first = store.commit(one, "load")
    second, report = vs.apply_clean(store, ["missing_answer"], first["digest"])
    assert report["removed"] == 1 and store.read().count() == 1
    with pytest.raises(RuntimeError):
        store.commit(one, "stale", expected=first["digest"])
    with pytest.raises(RuntimeError):
        vs.apply_clean(store, None, first["digest"])
    back = store.rollback(first["id"], second["digest"])
    assert back["digest"] == first["digest"] and store.read().count() == 2 and store.read(second["id"]).count() == 1
    assert [r["label"].split()[0] for r in store.versions().collect()] == ["rollback", "before:", "rule-based", "before:", "load"]


def test_infer_caches_retries_and_marks_failures(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def fn(prompt):
        (log / uuid.uuid4().hex).write_text(prompt)
        if prompt == "net":
            raise ConnectionError()
        if prompt == "bad":
            raise KeyError("x")
        return {"content": "{" if prompt == "json" else '{"ok": 1}', "finish_reason": "length" if prompt == "long" else "stop", "usage": {"total_tokens": 2}}

    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "a", "net", "bad", "json", "long"])], "pos long, prompt string")
    keyed = rows.withColumn("key", inf.request_key("v", "m", "e", "t", {"x": 1}, "prompt"))
    path = str(tmp_path / "cache")
    got = {r["pos"]: (r["status"], r["error"]) for r in inf.infer_to_table(keyed, fn, path, 2, wait=0.01).collect()}
    assert got == {0: ("ok", None), 1: ("ok", None), 2: ("error", "ConnectionError"), 3: ("error", "KeyError"), 4: ("error", "JSONDecodeError"), 5: ("error", "truncated")}
    calls = [p.read_text() for p in log.iterdir()]
    assert {c: calls.count(c) for c in set(calls)} == {"a": 1, "net": 3, "bad": 1, "json": 3, "long": 1}
    inf.infer_to_table(keyed, fn, path, 2, wait=0.01)
    assert [p.read_text() for p in log.iterdir()].count("a") == 1


def test_request_key_covers_everything(spark):
    base = dict(version="v", model="m", endpoint="e", task="t", policy={"a": 1})
    variants = [base, {**base, "task": "u"}, {**base, "policy": {"a": 2}}, {**base, "version": "w"}]
    df = spark.createDataFrame([("p",)], "p string")
    keys = [df.select(inf.request_key(prompt="p", **x)).first()[0] for x in variants]
    keys.append(df.select(inf.request_key(prompt="p", image=F.lit(b"1"), **base)).first()[0])
    assert len(set(keys)) == 5


def test_progress_resets_with_the_stage(spark):
    rows = [("s", "read", 1, 0.5, 0, 1), ("s", "read", 2, 1.0, 10, 2), ("s", "read", 1, 1.0, 20, 3), ("t", "read", 1, 1.0, 0, 4), ("t", "check", 1, 0.0, 30, 5), ("t", "read", 2, 0.5, 40, 6), ("t", "read", 3, 0.5, 60, 7)]
    e = spark.createDataFrame(rows, "session string, stage string, file int, fraction double, s long, event_id long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["session"]: (r["stage"], r["total"], r["done"], r["remaining_files"], r["eta_seconds"]) for r in rp.progress(e).collect()}
    assert got == {"s": ("read", 2, 2.0, 0, 0), "t": ("read", 2, 1.0, 2, 20)}


def test_progress_stream_over_several_batches(spark, sf, tmp_path):
    e = v.progress_events(spark, sf)
    src = str(tmp_path / "src")
    e.repartitionByRange(6, "event_id").sortWithinPartitions("event_id").write.parquet(src)
    out = str(tmp_path / "out")

    def save(batch, n):
        batch.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b={n}")

    s = st.progress_stream(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 6).parquet(src))
    s.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    last = rows.groupBy("session").agg(F.max(F.struct("n", "stage", "total", "done", "remaining_files", "eta_seconds")).alias("r")).collect()
    got = {int(r["session"]): tuple(r["r"])[1:] for r in last}
    want = {r["session"]: (r["stage"], r["total"], r["done"], r["remaining_files"], r["eta_seconds"]) for r in rp.progress(e).collect()}
    assert got == want


def test_ingest_stream_replays_without_repeats(spark, tmp_path):
    cols = "pos long, stem string, options array<string>, answer string, remark string, status string, figure_status string, suspected boolean, review_flags array<string>"
    src, bank = str(tmp_path / "src"), str(tmp_path / "bank")
    row = lambda i, s: (i, s, [], "A", "", None, None, False, [])
    spark.createDataFrame([row(1, "a"), row(2, "b")], cols).write.parquet(f"{src}")
    start = lambda ck: st.ingest_stream(spark.readStream.schema(cols).parquet(src), bank, str(tmp_path / ck)).trigger(availableNow=True).start().awaitTermination()
    start("one")
    spark.createDataFrame([row(3, " a "), row(4, "c")], cols).write.mode("append").parquet(src)
    start("one")
    assert {r["pos"] for r in spark.read.parquet(bank).collect()} == {1, 2, 4}
    start("two")  # all again from the beginning, as batch 0: its own folder is written anew
    assert sorted(r["pos"] for r in spark.read.parquet(bank).collect()) == [1, 2, 4]


def test_a_batch_reads_the_folders_of_its_own_fingerprints(spark, tmp_path):
    bank = str(tmp_path / "bank")
    digits = [f"{i % 10}{i // 10 % 10}" for i in range(100)]  # names of folders that look like numbers
    rows = spark.createDataFrame([(f"{d}ab", i % 3, d) for i, d in enumerate(digits)], "fingerprint string, batch long, prefix string")
    rows.write.partitionBy("batch", "prefix").parquet(bank)
    held = st.held_fingerprints(spark, bank, ["00", "10", "07"], 1)
    assert {r["fingerprint"] for r in held.collect()} == {f"{d}ab" for i, d in enumerate(digits) if d in ("00", "10", "07") and i % 3 != 1}
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "prefix#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert len(held.collect()) < 4 and st.held_fingerprints(spark, bank, [], 1).collect() == []


def test_selection_flow(spark, sf):
    b = v.bank(spark, sf)
    groups = [{"count": 5, "query": {"keywords": ["the"]}}, {"count": 5, "query": {"keywords": ["on"]}}]
    paper, report = curate.selection_paper(b, groups)
    assert report.agg(F.sum("selected")).first()[0] == 10
    assert paper.filter("part = 0 AND line_no = 0").count() == 10


def test_extraction_flow(spark, sf):
    reviewed = curate.reviewed_questions(v.items(spark, sf), v.docs(spark, sf), v.docs(spark, sf).limit(0).select(
        "id", F.lit(0).alias("ordinal"), "role", F.lit(1).alias("start_page"), F.lit(1).alias("end_page")))
    assert reviewed.count() == v.items(spark, sf).filter("kind = 'question'").count()
    assert reviewed.filter("solution_pos IS NOT NULL").count() > 0


def test_two_banks_have_places_of_their_own(spark, tmp_path):
    """Banks with a question in common: places are unique, and the copy goes when the banks are cleaned together."""
    from itembank.operators.clean import clean

    for name, stems in (("b", ["甲", "乙"]), ("a", ["丙", "甲", "丁"]), ("c", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"stem": s, "options": [], "answer": "A", "remark": ""} for s in stems]))
    bank = bk.read_bank(spark, str(tmp_path / "*.json"))
    assert [(r.pos, r.file_pos, r.stem) for r in bank.orderBy("pos").collect()] == [(0, 0, "丙"), (1, 1, "甲"), (2, 2, "丁"), (3, 0, "甲"), (4, 1, "乙")]
    kept = clean(bank)[0]
    assert sorted(r.pos for r in kept.collect()) == [0, 1, 2, 4]


def test_bundle_stores_what_it_refers_to(spark, tmp_path):
    """Equal bytes under two suffixes are one file, which both references name."""
    files = spark.createDataFrame([("a.png", bytearray(b"1")), ("b.jpg", bytearray(b"1"))], "path string, content binary")
    q = spark.createDataFrame([(0, "b.jpg", ["a.png"]), (1, "a.png", ["b.jpg"])], "pos long, image string, images array<string>")
    bk.write_bundle(q, files, str(tmp_path / "out"))
    named = {x for r in spark.read.json(str(tmp_path / "out/questions")).collect() for x in [r.image, *r.images]}
    assert named == {r["name"] for r in spark.read.parquet(str(tmp_path / "out/images")).collect()} and len(named) == 1


def test_digest_tells_nulls_apart(spark):
    one, two = (spark.createDataFrame([r], "a string, b string") for r in (("x", None), (None, "x")))
    assert vs.content_digest(one) != vs.content_digest(two)


def test_streams_read_a_table_of_many_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "user", 0, "abc"), (1, "assistant", 1, "de"), (2, "user", 0, "f")], "conv_id long, role string, turn int, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "one" / "conversations.parquet")
    for folder in ("many", "one"):
        got = {tuple(r) for r in QUERIES["usage_stream"](spark, str(tmp_path / folder)).collect()}
        assert got == {(1, 3, 2, 5, 2), (2, 1, 0, 1, 1)}
