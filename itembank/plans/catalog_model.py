"""Registered queries of model calls, corrections, storage and streams."""
from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from itembank.functions import ocr
from itembank.operators import infer as inf
from itembank.plans.catalog_bank import SQL_ETA, SQL_FP
from itembank.plans.catalog_text import SQL_STATE, state_rows
from itembank.plans.registry import query
from itembank.session import checkpoint_dir
from itembank.sources import bank as bk
from itembank.sources import versions as vs
from itembank.sources import views as v
from itembank.streaming import streams as st


def scratch(spark) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/itembank-{uuid.uuid4().hex}"


def stub_model(prompt: str) -> dict:
    """Deterministic stand-in for a model: counts characters; one prompt in eight, by digest, comes back truncated."""
    long = hashlib.md5(prompt.encode()).hexdigest()[0] in "01"
    return {
        "content": json.dumps({"chars": len(prompt)}), "finish_reason": "length" if long else "stop",
        "usage": {"prompt_tokens": len(prompt), "completion_tokens": 1, "total_tokens": len(prompt) + 1},
    }


@query("", "SELECT doc_id, CASE WHEN cut THEN 'error' ELSE 'ok' END AS status, CASE WHEN cut THEN -1 ELSE length(text) END AS chars, CASE WHEN cut THEN 'truncated' ELSE '' END AS error FROM (SELECT *, left(md5(text), 1) IN ('0', '1') AS cut FROM documents)")
def cached_infer(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    d = d.withColumn("key", inf.request_key("v1", "stub", "local", "count", {}, "prompt"))
    out = inf.infer_to_table(d, stub_model, scratch(spark), spark.sparkContext.defaultParallelism)
    return out.select(
        "doc_id", "status", F.coalesce(F.get_json_object("response", "$.chars").cast("long"), F.lit(-1)).alias("chars"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query("", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS round FROM documents WHERE doc_id % 6 <> 0")
def retry_missing(spark, sf):
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("finding"))
    first = docs.filter("id % 3 <> 0")  # the first round leaves every third row out, the second every sixth
    found, _ = inf.retry_missing(docs.select("id"), first, lambda left: docs.filter("id % 6 <> 0").join(left, "id", "left_semi"))
    return found.select("id", "round")


@query("bank", """, b AS (SELECT *, length(regexp_replace(regexp_replace(stem, '^\\s*1[.．、]', ''), '\\s+', '', 'g')) AS n FROM bank),
    s AS (SELECT *, CASE pos % 4 WHEN 0 THEN 'unchanged' WHEN 1 THEN CASE WHEN n >= 9 THEN 'corrected' ELSE 'unresolved' END ELSE 'unresolved' END AS status FROM b)
    SELECT pos, status FROM s""")
def safe_patch(spark, sf):
    """Re-read stems: equal, one character misread and anchored, cut short, or read in two ways."""
    p = F.col("pos") % 4
    b = v.bank(spark, sf)
    # A marker no stem contains stands for the misread character.
    before = F.when(p == 1, F.concat("stem", F.lit("¤"))).otherwise(F.col("stem"))
    first = (
        F.when(p == 0, F.col("stem")).when(p == 1, F.concat("stem", F.lit("§")))
        .when(p == 2, F.substring("stem", F.lit(2), F.length("stem"))).otherwise(F.concat("stem", F.lit("x")))
    )
    second = F.when(p == 3, F.concat("stem", F.lit("y"))).otherwise(first)
    props = b.select(
        "pos", F.lit("stem").alias("field"), F.lit("1").alias("number"), before.alias("before"), before.alias("quote"),
        first.alias("first"), second.alias("second"),
    )
    return ocr.review_readings(props).select("pos", "status")


@query("", """SELECT event_id, CASE event_id % 6 WHEN 4 THEN -1 WHEN 5 THEN -1 ELSE user_id % 9 + 1 END AS page, event_id % 6 IN (4, 5) AS failed FROM events""")
def locator_rows(spark, sf):
    e = v.table(spark, sf, "events").select("event_id", "user_id")
    k, page = F.col("event_id") % 6, (F.col("user_id") % 9 + 1).cast("string")
    box = "[10, 20, 200, 300]"
    reply = (
        F.when(k == 0, F.concat(F.lit('{"regions":[{"page":'), page, F.lit(f',"bbox":{box}}}]}}')))
        .when(k == 1, F.concat(F.lit('[{"page_name":"第'), page, F.lit(f'页","bbox_2d":{box}}}]')))
        .when(k == 2, F.lit(f'[{{"bbox":{box}}}]')).when(k == 3, F.concat(F.lit('{"page":"'), page, F.lit(f'","bbox":{box},"bbox_2d":{box}}}')))
        .when(k == 4, F.lit(f'[{{"page":99,"bbox":{box}}}]')).otherwise(F.lit('{"regions":[]}'))
    )
    out = e.select("event_id", ocr.locator_rows(reply, F.array(page.cast("int"))).alias("r"))
    return out.select(
        "event_id", F.coalesce(F.try_element_at("r.regions", F.lit(1))["page"], F.lit(-1)).alias("page"), F.col("r.error").isNotNull().alias("failed")
    )


# --- storage ----------------------------------------------------------------------------------

@query("bank", "SELECT pos, stem, answer, len(options) AS options FROM bank")
def json_bank_round_trip(spark, sf):
    """The bank written as JSON lines and read back."""
    path = scratch(spark) + ".jsonl"
    v.bank(spark, sf).select("pos", "stem", "options", "answer", "remark").write.json(path)
    return bk.read_bank_table(spark, path).select("pos", "stem", "answer", F.size("options").alias("options"))


@query("", """SELECT doc_id // 250 AS file, row_number() OVER (ORDER BY concat(doc_id // 250, '/'), doc_id) - 1 AS pos,
    row_number() OVER (PARTITION BY doc_id // 250 ORDER BY doc_id) - 1 AS file_pos, split_part(text, chr(10), 1) AS stem FROM documents""")
def read_bank_json(spark, sf):
    """The documents as many small JSON banks: arrays, or objects with a ``questions`` array."""
    path = scratch(spark)
    rows = v.table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 250).alias("file"), F.struct("doc_id", F.struct(F.split("text", "\n")[0].alias("stem")).alias("q")).alias("r")
    )
    # A bank file holds 250 rows, so its array is small by construction.
    arrays = rows.groupBy("file").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["q"]).alias("qs"))
    wrapped = F.when(F.col("file") % 2 == 0, F.to_json("qs")).otherwise(F.to_json(F.struct(F.col("qs").alias("questions"))))
    arrays.select("file", wrapped.alias("value")).write.partitionBy("file").text(path)
    back = bk.read_bank(spark, f"{path}/file=*")
    return back.select(F.regexp_extract("bank_file", r"file=(\d+)", 1).cast("long").alias("file"), "pos", "file_pos", "stem")


@query("", "SELECT doc_id, length(text) AS chars, sha256(text) AS digest FROM documents")
def read_documents(spark, sf):
    """Every document written to a text file of its own folder and read back by its suffix."""
    path = scratch(spark)
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    docs.select((F.col("doc_id") % 40).alias("part"), F.to_json(F.struct("doc_id", "text")).alias("value")).write.partitionBy("part").text(path)
    files = bk.read_documents(spark, [f"{path}/part={i}" for i in range(40)])
    lines = files.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    back = lines.select(F.from_json("line", "doc_id long, text string").alias("d"))
    return back.select("d.doc_id", F.length("d.text").alias("chars"), F.sha2("d.text", 256).alias("digest"))


@query("", """WITH r AS (SELECT doc_id, 'images/' || substr(sha256(html), 1, 24) AS image FROM documents JOIN pages ON page_id = doc_id % 50) SELECT doc_id AS pos, image FROM r""")
def write_bundle(spark, sf):
    path = scratch(spark)
    ref = F.concat(F.lit("page-"), (F.col("doc_id") % 50).cast("string"))
    q = v.table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), ref.alias("image"), F.array(ref).alias("images"))
    files = v.table(spark, sf, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("path"), F.col("html").cast("binary").alias("content"))
    bk.write_bundle(q, files, path)
    return spark.read.schema("pos long, image string").json(f"{path}/questions")


@query("bank", "SELECT 'rollback' AS label, (SELECT count(*) FROM bank) AS rows UNION ALL SELECT 'before: rollback', (SELECT count(*) FROM bank WHERE answer <> '') UNION ALL SELECT 'clean', (SELECT count(*) FROM bank WHERE answer <> '') UNION ALL SELECT 'before: clean', (SELECT count(*) FROM bank) UNION ALL SELECT 'load', (SELECT count(*) FROM bank)")
def version_history(spark, sf):
    """Load, clean with one rule, roll back: the log of versions."""
    store = vs.VersionStore(spark, scratch(spark))
    b = v.bank(spark, sf)
    first = store.commit(b, "load")
    kept, _ = vs.apply_clean(store, ["missing_answer"], first["digest"])
    store.rollback(first["id"], kept["digest"])
    label = F.regexp_replace(F.regexp_replace("label", "rule-based cleaning", "clean"), r"rollback to \w+", "rollback")
    return store.versions().select(label.alias("label"), F.col("count").alias("rows"))


# --- streams ----------------------------------------------------------------------------------

def _stream(spark, sf, name):
    """A table as a stream, be it one file or a folder of files. A stream takes one file only by a pattern, so the name is one."""
    schema = v.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _run(spark, stream, mode, keys):
    """Run a stream over what is there and return the last state of every key."""
    out, check = scratch(spark), scratch(spark)

    def save(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).drop("b")
    if not keys:
        return rows.drop("batch")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


@query("progress_events", f""", l AS (SELECT session, arg_max(stage, event_id) AS cur, max(ts) AS now FROM progress_events GROUP BY session),
    s AS (SELECT e.session, max(event_id) AS k FROM progress_events e JOIN l ON e.session = l.session AND e.stage <> l.cur GROUP BY e.session),
    f AS (SELECT e.session, l.cur AS stage, file, arg_max(fraction, event_id) AS fraction, min(ts) AS started, max(l.now) AS now FROM progress_events e JOIN l USING (session) LEFT JOIN s USING (session)
      WHERE e.stage = l.cur AND (s.k IS NULL OR event_id > s.k) GROUP BY e.session, l.cur, file),
    g AS (SELECT session, stage, count(*) AS total, sum(fraction) AS done, count_if(fraction >= 1) AS fin, min(started) AS started, max(now) AS now FROM f GROUP BY session, stage)
    SELECT session, stage, total, round(done, 6) AS done, greatest(0, total - fin) AS remaining_files, {SQL_ETA} AS eta_seconds FROM g""")
def progress_stream(spark, sf):
    e = _stream(spark, sf, "events").select(
        "event_id", "ts", (F.col("user_id") % 5).alias("session"), F.col("event_type").alias("stage"), F.col("user_id").alias("file"),
        F.least(F.lit(1.0), F.col("value") / 100.0).alias("fraction"),
    )
    return _run(spark, st.progress_stream(e), "update", ["session"])


@query("usage", "SELECT session, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS input, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS output, CAST(sum(coalesce(total_tokens, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0))) AS BIGINT) AS total, count(*) AS calls FROM usage GROUP BY session")
def usage_stream(spark, sf):
    n = F.length("text")
    u = _stream(spark, sf, "conversations").select(
        F.col("conv_id").alias("session"), F.when(F.col("role") != "assistant", n).alias("prompt_tokens"),
        F.when(F.col("role") == "assistant", n).alias("completion_tokens"), F.when(F.col("turn") % 3 == 0, n).alias("total_tokens"),
    )
    return _run(spark, st.usage_stream(u, ["session"]), "update", ["session"])


@query("", "SELECT event_type, date_trunc('day', ts) AS start, CAST(sum(user_id) AS BIGINT) AS total, count(*) AS calls FROM events GROUP BY ALL")
def usage_windows(spark, sf):
    e = _stream(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("total_tokens"))
    out = _run(spark, st.usage_windows(e, ["event_type"], "ts", "1 day", "1 hour"), "update", ["event_type", "start"])
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "total", "calls")


SQL_STREAMED = SQL_STATE + f", e AS (SELECT *, {SQL_FP} AS f FROM ps WHERE coalesce(status, '') <> 'discarded' AND answer <> '' AND NOT ((suspected AND figure_status <> 'confirmed') OR flagged)) SELECT f AS fingerprint, min(pos) AS pos FROM e GROUP BY f"


@query("bank", SQL_STREAMED)
def ingest_stream(spark, sf):
    """The bank's own rows arriving as a stream: every fingerprint is added once."""
    source, target = scratch(spark), scratch(spark)
    rows = state_rows(spark, sf).select("pos", "stem", "options", "answer", "remark", "status", "figure_status", "suspected", "review_flags")
    rows.repartitionByRange(4, "pos").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    st.ingest_stream(stream, target, scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).select("fingerprint", "pos")
