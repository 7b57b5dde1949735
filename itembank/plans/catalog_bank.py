"""Registered queries of cleaning, duplicates, review, ingest and reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from itembank.functions import predicates as pr
from itembank.functions import text as tx
from itembank.operators import batches as bt
from itembank.operators import clean as cl
from itembank.operators import dedupe as dd
from itembank.operators import ingest as ing
from itembank.operators import neardup as nd
from itembank.operators import report as rp
from itembank.operators import review as rv
from itembank.operators import select as sel
from itembank.plans.catalog_docs import stored_items
from itembank.plans.catalog_text import SQL_KEY, SQL_KEY_COMPAT, SQL_STATE, state_rows
from itembank.plans.oracle_views import VIEWS
from itembank.plans.registry import query
from itembank.sources import views as v

SQL_CLEAN = """, k AS (SELECT *, regexp_replace(stem, '\\s+', '', 'g') AS sk FROM bank),
    c AS (SELECT sk FROM k WHERE answer <> '' GROUP BY sk HAVING count(DISTINCT answer) > 1),
    m AS (SELECT k.*, answer = '' AS miss, flagged OR c.sk IS NOT NULL AS conf FROM k LEFT JOIN c USING (sk)),
    f AS (SELECT sk, min(pos) AS fp FROM m WHERE NOT miss AND NOT conf GROUP BY sk),
    r AS (SELECT m.*, NOT miss AND NOT conf AND pos > fp AS dup FROM m LEFT JOIN f USING (sk))"""


@query("bank", "SELECT pos, stem FROM bank WHERE trim(answer) = ''")
def missing_answers(spark, sf):
    return cl.missing_answers(v.bank(spark, sf)).select("pos", "stem")


@query("bank", SQL_CLEAN + " SELECT pos, answer FROM m WHERE conf")
def answer_conflicts(spark, sf):
    return cl.answer_conflicts(v.bank(spark, sf)).select("pos", "answer")


@query("bank", ", k AS (SELECT pos, row_number() OVER (PARTITION BY regexp_replace(stem, '\\s+', '', 'g') ORDER BY pos) AS rn FROM bank) SELECT pos FROM k WHERE rn > 1")
def duplicate_stems(spark, sf):
    return cl.duplicate_stems(v.bank(spark, sf)).select("pos")


@query("bank", SQL_CLEAN + " SELECT pos, concat_ws('|', CASE WHEN miss THEN 'missing_answer' END, CASE WHEN conf THEN 'answer_conflict' END, CASE WHEN dup THEN 'duplicate_stem' END) AS reasons FROM r WHERE miss OR conf OR dup")
def clean_removed(spark, sf):
    return cl.clean(v.bank(spark, sf))[1].select("pos", F.array_join("reasons", "|").alias("reasons"))


@query("bank", SQL_CLEAN + """ SELECT pos, sha256(stem) AS stem, sha256(array_to_string(list_transform(options, lambda o: trim(regexp_replace(o, '^\\s*[A-Z][.:)]\\s*', ''))), chr(10))) AS options
    FROM r WHERE NOT (miss OR conf OR coalesce(dup, FALSE))""")
def clean_rows(spark, sf):
    kept = cl.clean(v.bank(spark, sf))[0]
    return kept.select("pos", F.sha2("stem", 256).alias("stem"), F.sha2(F.array_join("options", "\n"), 256).alias("options"))


@query("bank", SQL_CLEAN + """ SELECT count(*) AS before, count_if(NOT (miss OR conf OR coalesce(dup, FALSE))) AS after, count_if(miss OR conf OR coalesce(dup, FALSE)) AS removed,
    count_if(NOT (miss OR conf OR coalesce(dup, FALSE)) AND len(list_filter(options, lambda o: trim(regexp_replace(o, '^\\s*[A-Z][.:)]\\s*', '')) <> o)) > 0) AS normalized,
    count_if(miss) AS missing_answer, count_if(conf) AS answer_conflict, count_if(dup) AS duplicate_stem FROM r""")
def clean_report(spark, sf):
    return cl.clean(v.bank(spark, sf))[2]


@query("bank", SQL_CLEAN + " SELECT 'missing_answer' AS rule, count_if(miss) AS n FROM r UNION ALL SELECT 'answer_conflict', count_if(conf) FROM r UNION ALL SELECT 'duplicate_stem', count_if(dup) FROM r")
def clean_counts(spark, sf):
    return cl.clean_counts(cl.with_reasons(v.bank(spark, sf)))


def _sql_dups(key: str, blank: str = "dk <> '|'") -> str:
    return f", k AS (SELECT *, {key} AS dk FROM bank), d AS (SELECT *, count(*) OVER (PARTITION BY dk) AS n, min(pos) OVER (PARTITION BY dk) AS g FROM k), x AS (SELECT * FROM d WHERE n > 1 AND {blank})"


@query("bank", _sql_dups(SQL_KEY) + " SELECT pos, g AS group_pos, n AS group_size, pos = g AS keep FROM x")
def exact_duplicates(spark, sf):
    return dd.exact_duplicates(v.bank(spark, sf)).select("pos", "group_pos", "group_size", "keep")


@query("bank", _sql_dups(SQL_KEY_COMPAT, "TRUE") + " SELECT pos, g AS group_pos, n AS group_size, pos = g AS keep FROM x")
def exact_duplicates_compat(spark, sf):
    return dd.exact_duplicates(v.bank(spark, sf), compat=True).select("pos", "group_pos", "group_size", "keep")


@query("bank", _sql_dups(SQL_KEY) + """ SELECT dense_rank() OVER (ORDER BY g) AS group_no, CASE WHEN pos = g THEN '保留' ELSE '删除候选' END AS action, pos + 1 AS id, substr(stem, 1, 140) AS stem,
    substr(array_to_string(options, ' | '), 1, 160) AS options, answer, substr(remark, 1, 120) AS remark FROM x""")
def duplicate_report(spark, sf):
    return dd.duplicate_report(dd.exact_duplicates(v.bank(spark, sf)))


@query("bank", _sql_dups(SQL_KEY) + " SELECT count_if(pos = g) AS groups, count_if(pos <> g) AS removable FROM x")
def duplicate_totals(spark, sf):
    return dd.duplicate_totals(dd.exact_duplicates(v.bank(spark, sf)))


@query("bank", _sql_dups(SQL_KEY) + " SELECT pos, answer FROM bank WHERE pos NOT IN (SELECT pos FROM x WHERE pos <> g)")
def drop_duplicates_plan(spark, sf):
    b = v.bank(spark, sf)
    return dd.drop_duplicates_plan(b, dd.exact_duplicates(b)).select("pos", "answer")


@query()
def near_duplicates(spark, sf):
    return nd.near_duplicates(v.bank(spark, sf))


# --- review -----------------------------------------------------------------------------------

@query("bank", SQL_STATE + " SELECT count_if(wait) AS pending, count_if(answer = '' AND coalesce(status, '') <> 'discarded') AS missing, count_if(coalesce(status, '') = 'discarded') AS discarded, count(*) AS total FROM ps")
def queue_counts(spark, sf):
    return rv.queue_counts(state_rows(spark, sf))


SQL_QUEUE = SQL_STATE + """, q AS (SELECT pos, row_number() OVER (ORDER BY pos) AS place, count(*) OVER () AS count, figure_status <> 'confirmed' AS figure_open,
    coalesce(lead(pos) OVER (ORDER BY pos), first_value(pos) OVER (ORDER BY pos)) AS next_pos FROM ps WHERE wait)"""


@query("bank", SQL_QUEUE + " SELECT * FROM q")
def review_queue(spark, sf):
    return rv.review_queue(state_rows(spark, sf))


@query("bank", SQL_QUEUE + " SELECT coalesce(min(CASE WHEN figure_open THEN pos END), min(pos)) AS pos, max(count) AS count FROM q")
def opening_card(spark, sf):
    return rv.opening_card(rv.review_queue(state_rows(spark, sf)))


@query("bank", """, h AS (SELECT pos, source_file, CASE WHEN len(options) > 0 THEN 'options[0]' ELSE 'stem' END AS field,
      row_number() OVER (PARTITION BY source_file ORDER BY sha256(concat(source_file, 'q', CAST(pos AS VARCHAR)))) AS rank, count(*) OVER (PARTITION BY source_file) AS n FROM bank)
    SELECT pos, source_file, field, rank FROM h WHERE rank <= greatest(1, (n + 9) // 10) AND pos NOT IN (SELECT pos FROM bank WHERE flagged)""")
def review_sample(spark, sf):
    b = v.bank(spark, sf)
    return rv.review_sample(b, b.filter("flagged"))


def _questions(spark, sf):
    b = state_rows(spark, sf)
    return b.select(
        "pos", "stem", "options", "answer", F.col("remark").alias("explanation"), "status", "figure_status", "suspected", "review_flags",
        F.sha2(F.concat_ws("|", F.col("pos").cast("string"), "stem"), 256).alias("identity"),
    )


SQL_DECIDED = SQL_STATE + """, j AS (SELECT ps.*, d.pos AS asked, d.decision, d.event_id, CASE WHEN ps.pos IS NULL THEN 'unknown row' WHEN d.decision NOT IN ('accepted', 'discarded', 'pending') THEN 'unknown decision'
      WHEN d.event_id % 10 = 0 THEN 'stale' WHEN d.decision = 'accepted' AND answer = '' THEN 'no answer'
      WHEN d.decision = 'accepted' AND suspected AND figure_status <> 'confirmed' THEN 'figure not confirmed' END AS reject FROM decisions d LEFT JOIN ps USING (pos)),
    a AS (SELECT asked AS pos, arg_max(decision, event_id) AS decision, bool_or(decision = 'accepted') AS clear, count(*) AS n FROM j WHERE reject IS NULL GROUP BY asked)"""


def _decided(spark, sf):
    q = _questions(spark, sf)
    token = F.when(F.col("event_id") % 10 == 0, F.lit("old")).otherwise(F.col("identity"))
    log = v.decisions(spark, sf).join(q.select("pos", "identity"), "pos", "left")
    # The event id orders the log, as its timestamps do.
    stamped = log.select("pos", token.alias("token"), "decision", F.timestamp_micros("event_id").alias("ts"), "event_id")
    return rv.apply_question_decisions(q, stamped)


@query("bank decisions", SQL_DECIDED + """ SELECT ps.pos, coalesce(a.decision, ps.status, '') AS status, CASE WHEN clear THEN 0 ELSE CAST(flagged AS INT) END AS flags, coalesce(a.n, 0) AS history
    FROM ps LEFT JOIN a ON a.pos = ps.pos""")
def apply_decisions(spark, sf):
    return _decided(spark, sf)[0].select("pos", F.coalesce("status", F.lit("")).alias("status"), F.size("review_flags").alias("flags"), F.col("decisions").alias("history"))


@query("bank decisions", SQL_DECIDED + """ SELECT event_id, asked AS pos, decision, coalesce(lag(decision) OVER w, status, '') AS previous,
    CASE WHEN coalesce(max(CAST(decision = 'accepted' AS INT)) OVER (PARTITION BY asked ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 0 ELSE CAST(flagged AS INT) END AS flags
    FROM j WHERE reject IS NULL WINDOW w AS (PARTITION BY asked ORDER BY event_id)""")
def decision_history(spark, sf):
    return _decided(spark, sf)[1].select("event_id", "pos", "decision", F.coalesce("previous_status", F.lit("")).alias("previous"), F.size("previous_flags").alias("flags"))


@query("bank decisions", SQL_DECIDED + " SELECT event_id, asked AS pos, decision, reject AS reason FROM j WHERE reject IS NOT NULL")
def rejected_decisions(spark, sf):
    return _decided(spark, sf)[2].select("event_id", "pos", "decision", "reason")


@query("bank", """, e AS (SELECT *, CASE WHEN pos % 7 = 2 THEN 'stale' WHEN pos % 7 = 4 THEN 'blank stem' WHEN pos % 7 = 5 THEN 'uncertain text' END AS reject, pos % 7 <> 6 AS edited FROM bank)
    SELECT pos, CASE WHEN edited AND reject IS NULL THEN 'T' ELSE answer END AS answer, CASE WHEN edited AND reject IS NULL THEN 0 ELSE CAST(flagged AS INT) END AS flags, edited AND reject IS NULL AS stored FROM e""")
def apply_text_edits(spark, sf):
    q = _questions(spark, sf)
    p = F.col("pos") % 7
    edits = q.filter(p != 6).select(
        "pos", F.when(p == 2, "old").otherwise(F.col("identity")).alias("token"),
        F.when(p == 4, "  ").when(p == 5, "<uncertain>").otherwise(F.col("stem")).alias("stem"), "options", F.lit("T").alias("answer"),
        "explanation", F.timestamp_seconds(F.col("pos")).alias("ts"),
    )
    out, _ = rv.apply_text_edits(q, edits)
    return out.select("pos", "answer", F.size("review_flags").alias("flags"), F.col("previous_values").isNotNull().alias("stored"))


def _figures(rows):
    p = F.col("pos")
    fig = F.struct((p % 4).cast("int").alias("page"), F.array(F.lit(10.0), F.lit(10.0), (F.lit(20) + p % 50).cast("double"), F.lit(300.0)).alias("bbox"))
    return rows.withColumn("figures", F.when(p % 3 == 0, F.array(fig)).otherwise(F.array().cast("array<struct<page:int,bbox:array<double>>>")))


#: Actions of three turns on every question; the first leaves every fifth question as it is.
SQL_FIGURES = """, e AS (SELECT *, turn, CASE (pos + turn * 3) % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'confirm' WHEN 2 THEN 'replace' WHEN 3 THEN 'crop' END AS act FROM bank, range(3) t(turn)),
    s AS (SELECT *, CASE WHEN act = 'none' AND pos % 11 <> turn THEN 0 WHEN act = 'replace' AND pos % 11 <> turn THEN 1 END AS sets FROM e WHERE act IS NOT NULL),
    m AS (SELECT *, last_value(sets IGNORE NULLS) OVER (PARTITION BY pos ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
    r AS (SELECT *, coalesce(before, CAST(pos % 3 = 0 AS INT)) AS met, CASE WHEN act = 'crop' THEN 'unknown action' WHEN pos % 11 = turn THEN 'stale' WHEN act <> 'confirm' THEN NULL
      WHEN coalesce(before, CAST(pos % 3 = 0 AS INT)) = 0 THEN 'no figure' WHEN before IS NULL AND pos % 50 + 10 < 15 THEN 'bad region' END AS reject FROM m)"""


def _figured(spark, sf):
    q = _figures(_questions(spark, sf))
    turn = F.col("turn")
    p = (F.col("pos") + turn * 3) % 5
    action = F.when(p == 0, "none").when(p == 1, "confirm").when(p == 2, "replace").when(p == 3, "crop")
    box = F.array(*[F.lit(float(x)) for x in (0, 0, 500, 500)])
    new = F.array(F.struct(F.lit(1).alias("page"), box.alias("bbox")))
    turns = q.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(2))))
    log = turns.select("pos", F.when(F.col("pos") % 11 == turn, "old").otherwise(F.col("identity")).alias("token"), action.alias("action"), new.alias("regions"), F.timestamp_seconds(turn * 5000).alias("ts"), turn.alias("event_id"))
    return rv.apply_figure_decisions(q, log.filter("action IS NOT NULL"), F.array(*[F.lit(i) for i in range(4)]))


@query("bank", SQL_FIGURES + """, a AS (SELECT pos, arg_max(sets, turn) FILTER (WHERE sets IS NOT NULL) AS sets, arg_max(act, turn) AS action, count(*) AS n FROM r WHERE reject IS NULL GROUP BY pos)
    SELECT bank.pos, coalesce(a.sets, CAST(bank.pos % 3 = 0 AS INT)) AS figures, a.n IS NOT NULL OR bank.pos % 2 = 0 AS confirmed, coalesce(a.n, 0) AS decisions, coalesce(a.action, '') AS action FROM bank LEFT JOIN a ON a.pos = bank.pos""")
def apply_figure_decisions(spark, sf):
    return _figured(spark, sf)[0].select(
        "pos", F.size("figures").alias("figures"), (F.coalesce(F.col("figure_status"), F.lit("")) == "confirmed").alias("confirmed"),
        F.col("figure_decisions").alias("decisions"), F.coalesce("figure_action", F.lit("")).alias("action"))


@query("bank", SQL_FIGURES + " SELECT pos, turn, act AS action, met AS figures, reject AS reason FROM r WHERE reject IS NULL UNION ALL SELECT pos, turn, act, -1, reject FROM r WHERE reject IS NOT NULL")
def figure_decision_log(spark, sf):
    _, history, rejected = _figured(spark, sf)
    valid = history.select("pos", F.col("event_id").alias("turn"), "action", F.size("previous_figures").alias("figures"), F.lit(None).cast("string").alias("reason"))
    return valid.union(rejected.select("pos", "event_id", "action", F.lit(-1), "reason"))


@query("bank", """, c AS (SELECT pos, CASE pos % 4 WHEN 0 THEN 'corrected' WHEN 1 THEN 'unresolved' ELSE 'unchanged' END AS status FROM bank WHERE flagged)
    SELECT (SELECT count(*) FROM bank) AS checked, count(*) AS flagged_fields, count_if(status = 'corrected') AS corrected_fields,
    (SELECT count(DISTINCT pos) FROM (SELECT pos FROM c WHERE status = 'unresolved' UNION ALL SELECT pos FROM bank WHERE pos % 40 = 0)) AS unresolved_questions, 'needs_review' AS status FROM c""")
def review_summary(spark, sf):
    b = v.bank(spark, sf)
    p = F.col("pos")
    checks = b.filter("flagged").select("pos", F.lit("stem").alias("field"), F.when(p % 4 == 0, "corrected").when(p % 4 == 1, "unresolved").otherwise("unchanged").alias("status"))
    return rv.review_summary(checks, b.select("pos", F.when(p % 40 == 0, "unresolved").otherwise("checked").alias("status")))


# --- ingest -----------------------------------------------------------------------------------

SQL_FP = "sha256(regexp_replace(concat(stem, CAST(to_json(list_transform(options, lambda o: trim(regexp_replace(o, '^\\s*[A-Z][.:)]\\s*', '')))) AS VARCHAR)), '\\s+', '', 'g'))"
SQL_INGEST = SQL_STATE + f""", fp AS (SELECT *, {SQL_FP} AS f, CASE WHEN coalesce(status, '') = 'discarded' THEN 'discarded' WHEN answer = '' THEN 'missing_answer' WHEN (suspected AND figure_status <> 'confirmed') OR flagged THEN 'pending_review' END AS gate FROM ps),
    res AS (SELECT *, min(CASE WHEN gate IS NULL THEN pos END) OVER (PARTITION BY f) AS fpos FROM fp WHERE source_file <> 'src3'), held AS (SELECT DISTINCT f FROM fp WHERE source_file = 'src3'),
    pl AS (SELECT res.*, CASE WHEN gate IS NOT NULL THEN gate WHEN pos = fpos AND f NOT IN (SELECT f FROM held) THEN 'added' ELSE 'duplicates' END AS outcome FROM res)"""


def _plan(spark, sf):
    rows = state_rows(spark, sf)
    held = rows.filter("source_file = 'src3'")
    return held, ing.ingest_plan(held, rows.filter("source_file <> 'src3'"))


@query("bank", SQL_INGEST + " SELECT pos, f AS fingerprint, outcome FROM pl")
def ingest_plan(spark, sf):
    return _plan(spark, sf)[1].select("pos", "fingerprint", "outcome")


@query("bank", SQL_INGEST + """ SELECT count_if(outcome = 'added') AS added, count_if(outcome = 'discarded') AS discarded, count_if(outcome = 'missing_answer') AS missing_answer,
    count_if(outcome = 'duplicates') AS duplicates, count_if(outcome = 'pending_review') AS pending_review, count_if(outcome <> 'added') AS skipped,
    count_if(outcome = 'added') + (SELECT count(*) FROM bank WHERE source_file = 'src3') AS total FROM pl""")
def ingest_outcome(spark, sf):
    held, plan = _plan(spark, sf)
    return ing.ingest_outcome(plan, held)


@query("bank", "SELECT pos, sha256(array_to_string(list_transform(options, lambda o: trim(regexp_replace(o, '^\\s*[A-Z][.:)]\\s*', ''))), chr(10))) AS options, sha256(concat('#', tag, chr(10), remark)) AS remark, source_file, 'run1' AS agent_run FROM bank")
def to_bank_rows(spark, sf):
    rows = ing.to_bank_rows(v.bank(spark, sf).withColumnRenamed("remark", "explanation"), "run1")
    return rows.select("pos", F.sha2(F.array_join("options", "\n"), 256).alias("options"), F.sha2("remark", 256).alias("remark"), "agent_source.source_file", "agent_run")


@query("bank", f""", h AS (SELECT *, {SQL_FP} AS f FROM bank), o AS (SELECT f, count(*) AS n, string_agg(concat(answer, '~', remark), '^' ORDER BY answer, remark) AS c FROM h WHERE tag <> 'de' GROUP BY f),
    w AS (SELECT f, count(*) AS n, string_agg(concat(CASE WHEN flagged THEN 'X' ELSE answer END, '~', remark), '^' ORDER BY CASE WHEN flagged THEN 'X' ELSE answer END, remark) AS c FROM h WHERE tag <> 'es' GROUP BY f)
    SELECT f AS fingerprint, CASE WHEN o.n IS NULL THEN 'added' WHEN w.n IS NULL THEN 'removed' ELSE 'changed' END AS change, coalesce(o.n, 0) AS n_old, coalesce(w.n, 0) AS n_new
    FROM o FULL JOIN w USING (f) WHERE o.n IS NULL OR w.n IS NULL OR o.c <> w.c""")
def diff_versions(spark, sf):
    b = v.bank(spark, sf)
    new = b.filter("tag <> 'es'").withColumn("answer", F.when(F.col("flagged"), "X").otherwise(F.col("answer")))
    return ing.diff_versions(b.filter("tag <> 'de'"), new)


@query("bank", """, r AS (SELECT pos, trim(stem) AS stem, list_filter(list_transform(options, lambda o: trim(o)), lambda o: o <> '') AS opts, answer, concat('#', tag, chr(10), trim(remark, chr(32) || chr(10))) AS remark FROM bank WHERE NOT flagged)
    SELECT pos AS row_no, sha256(array_to_string(opts, chr(10))) AS options, answer, sha256(trim(remark, chr(32) || chr(10))) AS remark FROM r WHERE stem <> ''""")
def records_from_form(spark, sf):
    b = v.bank(spark, sf)
    form = b.select(F.col("pos").alias("row_no"), "stem", F.array_join("options", "\n").alias("options"), "answer", F.col("tag").alias("tags"), "remark", "image")
    records, _ = ing.records_from_form(form, b.filter("NOT flagged").select(F.col("pos").alias("row_no")))
    return records.select("row_no", F.sha2(F.array_join("options", "\n"), 256).alias("options"), "answer", F.sha2("remark", 256).alias("remark"))


# --- pool, paper, usage -----------------------------------------------------------------------

@query("bank", "SELECT pos, 0 AS side, pos AS ord FROM bank WHERE answer = 'T' UNION ALL SELECT pos, 1, -pos FROM bank WHERE tag = 'fr' AND answer <> 'T'")
def pool_add(spark, sf):
    b = v.bank(spark, sf)
    return sel.pool_add(b.filter("answer = 'T'").select("pos", F.col("pos").alias("ord")), b.filter("tag = 'fr'").select("pos", (-F.col("pos")).alias("ord")))


@query("bank", "SELECT pos FROM bank WHERE answer = 'T' AND tag <> 'fr'")
def pool_remove(spark, sf):
    b = v.bank(spark, sf)
    return sel.pool_remove(b.filter("answer = 'T'").select("pos"), b.filter("tag = 'fr'"))


@query("bank", "SELECT pos FROM bank WHERE answer <> 'F'")
def export_filter(spark, sf):
    b = v.bank(spark, sf)
    return sel.export_filter(b.withColumn("selection_review", F.struct(F.when(F.col("answer") == "F", "rejected").otherwise("accepted").alias("status")))).select("pos")


@query("bank", """, n AS (SELECT *, row_number() OVER (ORDER BY pos) AS no FROM bank),
    body AS (SELECT 0 AS part, no, 0 AS line_no, concat(no, '. ', regexp_replace(stem, '^([ ]*)[0-9]{1,3}\\s*[.、]([^0-9])', '\\1\\2')) AS text FROM n
      UNION ALL SELECT 0, no, u.i, CASE WHEN regexp_matches(u.o, '^[A-Z][.、]') THEN u.o ELSE concat(chr(64 + u.i::INT), '. ', u.o) END
        FROM (SELECT no, unnest(list_transform(list_zip(options, range(1, len(options) + 1)), lambda x: {'o': x[1], 'i': x[2]})) AS u FROM n)),
    ans AS (SELECT 1 AS part, no, 0 AS line_no, concat(no, '. ', CASE answer WHEN '' THEN '原题未提供答案' ELSE answer END) AS text FROM n UNION ALL SELECT 1, no, 1, remark FROM n WHERE remark <> '')
    SELECT part, no, line_no, sha256(text) AS text FROM body UNION ALL SELECT part, no, line_no, sha256(text) FROM ans""")
def paper_rows(spark, sf):
    return rp.paper_rows(v.bank(spark, sf)).select("part", "no", "line_no", F.sha2("text", 256).alias("text"))


@query("usage", "SELECT session, task, CAST(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS input, CAST(sum(coalesce(completion_tokens, 0)) AS BIGINT) AS output, CAST(sum(coalesce(total_tokens, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0))) AS BIGINT) AS total, count(*) AS calls, arg_max(coalesce(total_tokens, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)), ts) AS last_tokens FROM usage GROUP BY session, task")
def usage_totals(spark, sf):
    return rp.usage_totals(v.usage(spark, sf), ["session", "task"], "ts")


@query("usage", """SELECT session, CAST(max(ts * 10 + 3) - min(ts * 10) AS BIGINT) AS wall_seconds, count(*) AS calls, CAST(sum(3) AS BIGINT) AS request_seconds, CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS tokens,
    count_if(task = 'system') AS failures, count_if(task = 'system') > 0 OR session % 11 = 0 AS partial FROM usage GROUP BY session""")
def run_stats(spark, sf):
    u = v.usage(spark, sf)
    rows = u.select("session", (F.col("ts") * 10).alias("started"), F.lit(3).cast("long").alias("seconds"), "total_tokens")
    docs = u.select("session", F.when(F.col("session") % 11 == 0, 1).otherwise(2).alias("processed_pages"), F.lit(2).alias("total_pages"))
    return rp.run_stats(rows, ["session"], u.filter("task = 'system'"), docs)


SQL_ETA = """CASE WHEN done > 0 AND (epoch_us(now) - epoch_us(started)) / 1e6 >= 2 THEN CAST(round((epoch_us(now) - epoch_us(started)) / 1e6 / done * (total - done)) AS BIGINT) END"""


@query("progress_events", f""", f AS (SELECT session, stage, file, arg_max(fraction, event_id) AS fraction, min(ts) AS started, max(ts) AS now FROM progress_events GROUP BY session, stage, file),
    g AS (SELECT session, stage, count(*) AS total, sum(fraction) AS done, count_if(fraction >= 1) AS fin, min(started) AS started, max(now) AS now FROM f GROUP BY session, stage)
    SELECT session, stage, total, round(done, 6) AS done, greatest(0, total - fin) AS remaining_files, {SQL_ETA} AS eta_seconds FROM g""")
def stage_progress(spark, sf):
    return rp.stage_progress(v.progress_events(spark, sf))


@query("progress_events", f""", l AS (SELECT session, arg_max(stage, event_id) AS cur, max(ts) AS now FROM progress_events GROUP BY session),
    s AS (SELECT e.session, max(event_id) AS k FROM progress_events e JOIN l ON e.session = l.session AND e.stage <> l.cur GROUP BY e.session),
    f AS (SELECT e.session, l.cur AS stage, file, arg_max(fraction, event_id) AS fraction, min(ts) AS started, max(l.now) AS now FROM progress_events e JOIN l USING (session) LEFT JOIN s USING (session)
      WHERE e.stage = l.cur AND (s.k IS NULL OR event_id > s.k) GROUP BY e.session, l.cur, file),
    g AS (SELECT session, stage, count(*) AS total, sum(fraction) AS done, count_if(fraction >= 1) AS fin, min(started) AS started, max(now) AS now FROM f GROUP BY session, stage)
    SELECT session, stage, total, round(done, 6) AS done, greatest(0, total - fin) AS remaining_files, {SQL_ETA} AS eta_seconds FROM g""")
def progress(spark, sf):
    return rp.progress(v.progress_events(spark, sf))



# --- batches ----------------------------------------------------------------------------------

@query("items", """SELECT pos, CAST(floor((row_number() OVER (PARTITION BY source_file ORDER BY pos) - 1) / 6) AS BIGINT) AS batch FROM items""")
def source_batches(spark, sf):
    return bt.batches_per_source(stored_items(spark, sf, "pos", "source_file"), "source_file").select("pos", "batch")


SQL_GREEDY = f"""WITH RECURSIVE graded AS ({VIEWS["graded"]}), bank AS ({VIEWS["bank"]}),
    z AS (SELECT pos, row_number() OVER (ORDER BY pos) AS rn, coalesce(length(stem), 0) + coalesce(length(answer), 0) AS size FROM bank),
    b AS (SELECT rn, pos, size AS total, 1 AS held, CAST(0 AS BIGINT) AS batch FROM z WHERE rn = 1 UNION ALL
      SELECT z.rn, z.pos, CASE WHEN held >= 12 OR total + size > 9000 THEN size ELSE total + size END,
        CASE WHEN held >= 12 OR total + size > 9000 THEN 1 ELSE held + 1 END,
        CASE WHEN held >= 12 OR total + size > 9000 THEN batch + 1 ELSE batch END FROM b JOIN z ON z.rn = b.rn + 1)
    SELECT pos, batch FROM b"""


@query("", SQL_GREEDY)
def greedy_batches(spark, sf):
    size = F.length("stem") + F.length(F.coalesce("answer", F.lit("")))
    return bt.greedy_batches(v.bank(spark, sf).select("pos", "stem", "answer"), size, 12, 9000).select("pos", "batch")
