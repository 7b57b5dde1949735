"""Registered queries of the column functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from itembank.functions import predicates as pr
from itembank.functions import query as qy
from itembank.functions import text as tx
from itembank.operators import select as sel
from itembank.plans.registry import query
from itembank.sources import views as v

SQL_WS = "regexp_replace({}, '\\s+', '', 'g')"
SQL_PUNCT = "，。、“”‘’；：！？,.\"'';:!?()[]{}<>《》【】（）"
SQL_KEY = (
    "concat(translate(regexp_replace(regexp_replace(lower(stem), '\\s+', '', 'g'), '^第?[0-9]+(?:题|[、)．]|\\.([^0-9]|$))', '\\1'), '"
    + SQL_PUNCT + "', ''), '|', translate(regexp_replace(lower(array_to_string(options, '')), '\\s+', '', 'g'), '" + SQL_PUNCT + "', ''))"
)
SQL_KEY_COMPAT = (
    "concat(regexp_replace(translate(regexp_replace(lower(stem), '\\s+', '', 'g'), '" + SQL_PUNCT + "', ''), '^第?[0-9]+[题、.)．]?', ''), '|', "
    "array_to_string(list_transform(options, lambda o: regexp_replace(translate(regexp_replace(lower(o), '\\s+', '', 'g'), '"
    + SQL_PUNCT + "', ''), '^第?[0-9]+[题、.)．]?', '')), ''))"
)
SQL_SEARCH = "trim(regexp_replace(lower(concat_ws(' ', stem, answer, remark, image, array_to_string(options, ' '))), '\\s+', ' ', 'g'))"
SQL_CLEAN_OPTS = "list_transform(options, lambda o: trim(regexp_replace(o, '^\\s*[A-ZＡ-Ｚ][.．、:：)）]\\s*', ''), chr(32) || chr(9) || chr(10) || chr(13)))"


@query("bank", "SELECT pos, sha256(regexp_replace(stem, '\\s+', '', 'g')) AS stem_key, regexp_replace(answer, '\\s+', '', 'g') AS answer_key FROM bank")
def ws_key(spark, sf):
    return v.bank(spark, sf).select("pos", F.sha2(tx.ws_key("stem"), 256).alias("stem_key"), tx.ws_key("answer").alias("answer_key"))


@query("bank", f"SELECT pos, sha256({SQL_KEY}) AS dup_key, sha256({SQL_KEY_COMPAT}) AS compat_key FROM bank")
def dedupe_key(spark, sf):
    return v.bank(spark, sf).select(
        "pos", F.sha2(tx.dedupe_key("stem", "options"), 256).alias("dup_key"),
        F.sha2(tx.dedupe_key("stem", "options", compat=True), 256).alias("compat_key"),
    )


@query("bank", "SELECT pos, sha256(trim(concat(trim(stem), ' ', array_to_string(list_transform(options, lambda o: trim(o)), ' ')))) AS shown FROM bank")
def dedupe_text(spark, sf):
    return v.bank(spark, sf).select("pos", F.sha2(tx.dedupe_text("stem", "options"), 256).alias("shown"))


def _labelled(spark, sf):
    """Stems with a printed label: plain, in words, of another number, or below a group label."""
    i = v.items(spark, sf).filter("kind = 'question'")
    n = F.when(F.col("number") == "", F.lit("7")).otherwise(F.substring("number", 1, 3))
    p = F.col("pos") % 5
    text = (
        F.when(p == 0, F.concat(n, F.lit(". "), "stem")).when(p == 1, F.concat(F.lit("第 "), n, F.lit(" 题："), "stem"))
        .when(p == 2, F.concat(F.lit("999. "), "stem")).when(p == 3, F.concat(F.lit("【1-9 为题组】材料\n"), n, F.lit("、"), "stem"))
        .otherwise(F.col("stem"))
    )
    return i.select("pos", F.col("stem").alias("plain"), text.alias("printed"), n.alias("n"), p.alias("p"), "number")


@query("items", """SELECT pos, sha256(CASE pos % 5 WHEN 2 THEN concat('999. ', stem) WHEN 3 THEN concat('材料', chr(10), stem) ELSE stem END) AS known,
    sha256(CASE pos % 5 WHEN 3 THEN concat('材料', chr(10), CASE number WHEN '' THEN '7' ELSE substr(number, 1, 3) END, '、', stem) ELSE stem END) AS unknown
    FROM items WHERE kind = 'question'""")
def clean_stem(spark, sf):
    return _labelled(spark, sf).select(
        "pos", F.sha2(tx.clean_stem("printed", F.col("n")), 256).alias("known"), F.sha2(tx.clean_stem("printed"), 256).alias("unknown")
    )


@query("items", """SELECT pos, CASE WHEN pos % 5 IN (0, 1) THEN CASE number WHEN '' THEN '7' ELSE substr(number, 1, 3) END WHEN pos % 5 = 2 THEN '999' ELSE '' END AS original_number,
    pos % 5 <> 4 AS changed FROM items WHERE kind = 'question'""")
def normalize_stem(spark, sf):
    stem, number = tx.normalize_stem("printed", F.lit(""))
    return _labelled(spark, sf).select(
        "pos", F.coalesce(number, F.lit("")).alias("original_number"), (stem != F.col("printed")).alias("changed")
    )


SQL_LETTERED = "list_transform(list_zip(options, range(len(options))), lambda x: concat(chr(65 + x[2]::INT), '. ', x[1]))"


@query("bank", f"""SELECT pos, sha256(array_to_string(list_transform(options, lambda o: trim(o)), chr(10))) AS cleaned,
    sha256(array_to_string(list_filter(list_transform(options, lambda o: trim(o)), lambda o: o <> ''), chr(10))) AS form FROM bank""")
def clean_options(spark, sf):
    lettered = F.transform("options", lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o))
    return v.bank(spark, sf).select(
        "pos", F.sha2(F.array_join(tx.clean_options(lettered), "\n"), 256).alias("cleaned"),
        F.sha2(F.array_join(F.filter(tx.clean_option_text(lettered), lambda o: o != ""), "\n"), 256).alias("form"),
    )


@query("bank", """, t AS (SELECT pos, stem, options, len(options) BETWEEN 2 AND 10 AND len(list_filter(options, lambda o: trim(o) <> '')) = len(options)
      AND NOT regexp_matches(stem, '^\\s*[A-Z][.:)]') AND len(list_filter(options, lambda o: regexp_matches(o, '^\\s*[A-Z][.:)]'))) = 0 AS ok FROM bank)
    SELECT pos, ok AS split, sha256(CASE WHEN ok OR len(options) = 0 THEN stem
      ELSE concat(stem, chr(10), array_to_string(list_transform(list_zip(options, range(len(options))), lambda x: concat(chr(65 + x[2]::INT), '. ', x[1])), chr(10))) END) AS stem FROM t""")
def split_embedded_options(spark, sf):
    lettered = F.transform("options", lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o))
    printed = F.when(F.size("options") == 0, F.col("stem")).otherwise(F.concat("stem", F.lit("\n"), F.array_join(lettered, "\n")))
    rows = v.bank(spark, sf).select("pos", tx.split_embedded_options(printed, "options").alias("s"))
    return rows.select("pos", F.col("s.split").alias("split"), F.sha2("s.stem", 256).alias("stem"))


@query("bank", """SELECT pos, concat('#', tag, ' #extra') AS tag_line, concat('#', tag, ' #extra', CASE WHEN trim(remark) = '' THEN '' ELSE concat(chr(10), trim(remark)) END) AS remark,
    CASE WHEN flagged THEN concat(tag, '|extra') ELSE '其他' END AS merged FROM (SELECT * REPLACE (left(trim(remark, chr(32) || chr(10)), 1000000) AS remark) FROM bank)""")
def tags_and_remark(spark, sf):
    raw = F.concat(F.lit("#"), "tag", F.lit("，extra "), "tag")
    tags = tx.tag_list(raw)
    none = F.array().cast("array<string>")
    return v.bank(spark, sf).select(
        "pos", tx.tag_line(tags).alias("tag_line"), tx.format_remark(tags, "remark").alias("remark"),
        F.array_join(tx.merge_tags(F.when(F.col("flagged"), tags).otherwise(none), F.when(F.col("flagged"), tags).otherwise(none)), "|").alias("merged"),
    )


@query("bank", """, a AS (SELECT pos, options, pos % 3 = 0 AS tf, CASE pos % 4 WHEN 0 THEN 't,f T/F' WHEN 1 THEN ' ACD ' WHEN 2 THEN '' ELSE answer END AS raw FROM bank)
    , n AS (SELECT *, CASE WHEN pos % 4 = 0 THEN 'TFTF' ELSE trim(raw) END AS normal FROM a)
    SELECT pos, normal AS answer, CASE WHEN normal = '' OR NOT tf THEN '' WHEN NOT regexp_full_match(normal, '[TF]+') THEN '判断题答案不是 T/F 序列'
      WHEN len(options) > 0 AND length(normal) <> len(options) THEN '判断题答案数量与选项不符' ELSE '' END AS flags FROM n""")
def answer_format(spark, sf):
    p = F.col("pos")
    raw = F.when(p % 4 == 0, "t,f T/F").when(p % 4 == 1, " ACD ").when(p % 4 == 2, "").otherwise(F.col("answer"))
    stem = F.when(p % 3 == 0, "判断正误").otherwise("x")
    rows = v.bank(spark, sf).select("pos", "options", stem.alias("cue"), tx.normalize_answer(raw).alias("answer"))
    return rows.select("pos", "answer", F.array_join(tx.format_flags("cue", "options", "answer"), "|").alias("flags"))


@query("items", "SELECT pos, number AS plain, number AS wide FROM items")
def normalize_number(spark, sf):
    wide = F.translate("number", "0123456789", "０１２３４５６７８９")
    return v.items(spark, sf).select(
        "pos", tx.normalize_number(F.concat(F.lit(" "), "number", F.lit("."))).alias("plain"),
        tx.normalize_number(F.concat(wide, F.lit("、"))).alias("wide"),
    )


@query("bank", f"""SELECT pos, sha256(regexp_replace(concat(stem, CAST(to_json({SQL_CLEAN_OPTS}) AS VARCHAR)), '\\s+', '', 'g')) AS fingerprint,
    sha256(concat('[', to_json(source_file), ', ', to_json(CAST(pos AS VARCHAR)), ', null, ', to_json(stem), ']')) AS identity FROM bank""")
def fingerprint_identity(spark, sf):
    return v.bank(spark, sf).select(
        "pos", tx.fingerprint("stem", "options").alias("fingerprint"),
        tx.identity("source_file", F.col("pos").cast("string"), F.lit(None).cast("string"), "stem").alias("identity"),
    )


@query("docs", "SELECT id, regexp_replace(replace(title, '答案', ''), '\\s+', '', 'g') AS title_key, concat(replace(id, '答案', ''), 'v2') AS grp_name FROM docs")
def title_keys(spark, sf):
    path = F.concat(F.lit("C:\\papers\\"), "id", F.lit("_答案 (v2).pdf"))
    return v.docs(spark, sf).select("id", tx.title_key("title").alias("title_key"), tx.group_name(path).alias("grp_name"))


@query("bank", f"""SELECT pos, sha256({SQL_SEARCH}) AS search_text,
    sha256(replace(lower(concat_ws(chr(10), stem, array_to_string(options, chr(10)), tag, remark)), 'ß', 'ss')) AS select_text FROM bank""")
def corpora(spark, sf):
    return v.bank(spark, sf).select(
        "pos", F.sha2(tx.search_corpus("stem", "answer", "remark", "image", "options"), 256).alias("search_text"),
        F.sha2(tx.select_corpus("stem", "options", "category_tags", "remark"), 256).alias("select_text"),
    )


@query("items", "SELECT pos, sha256(regexp_replace(stem, '\\s+', '', 'g')) AS compared FROM items")
def ocr_compare(spark, sf):
    """Printed with its number, if it has one, a stem compares equal to itself without white space."""
    i = v.items(spark, sf)
    printed = F.when(F.col("number") != "", F.concat("number", F.lit(". "), "stem")).otherwise(F.col("stem"))
    return i.select("pos", F.sha2(tx.ocr_compare(tx.strip_field_label(printed, F.lit("stem"), "number")), 256).alias("compared"))


@query("", """SELECT event_id, CASE WHEN event_id % 5 = 3 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def parse_model_json(spark, sf):
    e = v.table(spark, sf, "events").select("event_id", "props")
    p = F.col("event_id") % 5
    reply = (
        F.when(p == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(p == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" done")))
        .when(p == 3, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    )
    parsed = tx.parse_model_json(reply)
    return e.select("event_id", F.coalesce(F.try_variant_get(parsed, "$.k", "long"), F.lit(-1)).alias("k"))


SECRETS = ["Apache License", "Licensed under", "MIT"]


@query("", """SELECT doc_id, sha256(replace(replace(replace(text, 'Apache License', '[REDACTED]'), 'Licensed under', '[REDACTED]'), 'MIT', '[REDACTED]')) AS cleaned,
    CAST(contains(text, 'Apache License') AS INT) + CAST(contains(text, 'Licensed under') AS INT) AS found FROM documents""")
def redact_and_scan(spark, sf):
    d = v.table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(tx.redact("text", SECRETS), 256).alias("cleaned"), tx.leaks("text", SECRETS).alias("found"))


@query("", """, b AS (SELECT vec_id, label, list_transform(embedding[1:4], lambda x: floor(abs(CAST(x AS DOUBLE)) * 6000)) AS box FROM embeddings)
    SELECT vec_id, CASE WHEN label NOT IN (0, 1, 2, 3) THEN 'page' WHEN NOT (box[1] < box[3] AND box[3] <= 1000 AND box[2] < box[4] AND box[4] <= 1000) THEN 'bounds'
      WHEN box[3] - box[1] < 15 OR box[4] - box[2] < 15 THEN 'span' ELSE '' END AS error,
    round((100 + box[1] / 1000 * 700) / 1200 * 1000, 4) AS left_x, round((200 + box[4] / 1000 * 900) / 1600 * 1000, 4) AS bottom_y FROM b""".replace(", b AS", "WITH b AS", 1))
def regions(spark, sf):
    box = F.transform(F.slice("embedding", 1, 4), lambda x: F.floor(F.abs(x.cast("double")) * 6000).cast("double"))
    e = v.table(spark, sf, "embeddings").select("vec_id", "label", box.alias("box"))
    pages = F.array(*[F.lit(i) for i in range(4)])
    roi = F.array(*[F.lit(float(x)) for x in (100, 200, 800, 1100)])
    mapped = tx.map_local_box("box", roi, F.lit(1200.0), F.lit(1600.0))
    return e.select(
        "vec_id", F.coalesce(tx.region_error("label", "box", pages), F.lit("")).alias("error"),
        mapped[0].alias("left_x"), mapped[3].alias("bottom_y"),
    )


@query("", """SELECT label, min(floor(abs(CAST(embedding[1] AS DOUBLE)) * 6000)) AS l, min(floor(abs(CAST(embedding[2] AS DOUBLE)) * 6000)) AS t,
    max(floor(abs(CAST(embedding[3] AS DOUBLE)) * 6000)) AS r, max(floor(abs(CAST(embedding[4] AS DOUBLE)) * 6000)) AS b FROM embeddings GROUP BY label""")
def outer_box(spark, sf):
    box = F.transform(F.slice("embedding", 1, 4), lambda x: F.floor(F.abs(x.cast("double")) * 6000).cast("double"))
    e = v.table(spark, sf, "embeddings").select("label", box.alias("box"))
    return tx.outer_boxes(e, ["label"], "box")


@query("bank", """SELECT pos + 1 AS id, substr(stem, 1, 100) AS stem, substr(array_to_string(options, ' / '), 1, 140) AS options, substr(answer, 1, 24) AS answer, substr(remark, 1, 140) AS remark,
    concat(pos + 1, ' | ', CASE WHEN length(trim(stem)) > 88 THEN concat(substr(trim(stem), 1, 88), '...') ELSE trim(stem) END, ' | 答案:', answer) AS label FROM bank""")
def preview(spark, sf):
    from itembank.operators import report as rp

    b = v.bank(spark, sf)
    shown = rp.preview(b, {"stem": 100, "options": 140, "answer": 24, "remark": 140})
    labels = b.select((F.col("pos") + 1).alias("id"), tx.choice_label(F.col("pos") + 1, "stem", "answer").alias("label"))
    return shown.join(labels, "id")


# --- filters ----------------------------------------------------------------------------------

@query("bank", f"""SELECT pos + 1 AS id, substr(stem, 1, 90) AS stem, answer FROM bank WHERE contains({SQL_SEARCH}, 'the') AND contains({SQL_SEARCH}, 'and') ORDER BY pos LIMIT 80""")
def search_and(spark, sf):
    return sel.search(v.bank(spark, sf), "the, and").select("id", "stem", "answer")


@query("bank", f"""SELECT pos + 1 AS id, substr(stem, 1, 90) AS stem, answer FROM bank WHERE contains({SQL_SEARCH}, 'ße') OR contains({SQL_SEARCH}, 'licensed') ORDER BY pos LIMIT 80""")
def search_or(spark, sf):
    return sel.search(v.bank(spark, sf), "ße | Licensed").select("id", "stem", "answer")


@query("bank", f"""SELECT least(80, count_if(hit)) AS shown, count_if(hit) AS hits, count(*) AS total FROM (SELECT contains({SQL_SEARCH}, 'the') AND contains({SQL_SEARCH}, 'and') AS hit FROM bank)""")
def search_totals(spark, sf):
    return sel.search_counts(v.bank(spark, sf), "the and")


@query("bank", "SELECT pos, stem, answer FROM bank ORDER BY pos DESC LIMIT 50")
def recent_rows(spark, sf):
    return sel.recent(v.bank(spark, sf), 50).select("pos", "stem", "answer")


TREE = {"op": "AND", "keywords": ["the"], "clauses": [
    {"op": "OR", "keywords": ["licensed", "phone"], "clauses": [{"op": "AND", "keywords": ["and", "tion"]}]},
    {"op": "xor", "keywords": "er, on"},
]}


@query("bank", f""", c AS (SELECT *, {SQL_SEARCH} AS x FROM bank) SELECT pos FROM c WHERE contains(x, 'the') AND (contains(x, 'licensed') OR contains(x, 'phone') OR (contains(x, 'and') AND contains(x, 'tion')))
    AND (contains(x, 'er') OR contains(x, 'on')) AND NOT (contains(x, 'apache') OR contains(x, 'idiot'))""")
def match_tree(spark, sf):
    return sel.matching(v.bank(spark, sf), TREE, ["Apache", "idiot"]).select("pos")


@query("bank", f""", c AS (SELECT *, {SQL_SEARCH} AS x FROM bank), s AS (SELECT pos, CASE WHEN contains(x, 'the') THEN 40 ELSE 0 END + CASE WHEN contains(x, 'licensed') THEN 34 ELSE 0 END + CASE WHEN contains(x, 'phone') THEN 34 ELSE 0 END
    + CASE WHEN contains(x, 'and') THEN 28 ELSE 0 END + CASE WHEN contains(x, 'tion') THEN 28 ELSE 0 END + CASE WHEN contains(x, 'er') THEN 34 ELSE 0 END + CASE WHEN contains(x, 'on') THEN 34 ELSE 0 END
    + CASE WHEN contains(x, '脊椎动物学') THEN 30 ELSE 0 END + CASE WHEN contains(x, '文献题') OR contains(x, '图表题') THEN 5 ELSE 0 END AS score
    FROM c WHERE contains(x, 'the') AND (contains(x, 'licensed') OR contains(x, 'phone') OR (contains(x, 'and') AND contains(x, 'tion'))) AND (contains(x, 'er') OR contains(x, 'on')) AND NOT contains(x, 'apache'))
    SELECT pos, score FROM s ORDER BY score DESC, pos LIMIT 50""")
def scored_select(spark, sf):
    return sel.scored_select(v.bank(spark, sf), TREE, ["apache"], 50).select("pos", "score")


@query("bank", f""", c AS (SELECT *, {SQL_SEARCH} AS x FROM bank) SELECT pos, 34 * (1 + CAST(contains(x, 'er') AS INT) + CAST(contains(x, 'licensed') AS INT)) AS score FROM c
    WHERE contains(x, 'the') AND (contains(x, 'er') OR contains(x, 'licensed')) ORDER BY score DESC, pos LIMIT 30""")
def keyword_select(spark, sf):
    return sel.keyword_select(v.bank(spark, sf), ["the"], ["er", "licensed"], n=30).select("pos", "score")


SQL_SEL = "replace(lower(concat_ws(chr(10), stem, array_to_string(options, chr(10)), tag, remark)), 'ß', 'ss')"
GROUPS = [{"count": 40, "query": {"keywords": ["licensed", "the"]}}, {"count": 60, "query": {"op": "AND", "keywords": ["the", "And"]}, "exclude_keywords": ["apache"]}]
SQL_QUOTA = f""", c AS (SELECT pos, {SQL_SEL} AS x FROM bank), g0 AS (SELECT pos FROM c WHERE contains(x, 'licensed') OR contains(x, 'the')),
    s0 AS (SELECT pos FROM g0 ORDER BY pos LIMIT 40), g1 AS (SELECT pos FROM c WHERE contains(x, 'the') AND contains(x, 'and') AND NOT contains(x, 'apache') AND pos NOT IN (SELECT pos FROM s0)),
    s1 AS (SELECT pos FROM g1 ORDER BY pos LIMIT 60)"""


@query("bank", SQL_QUOTA + " SELECT pos, 0 AS sel_group FROM s0 UNION ALL SELECT pos, 1 FROM s1")
def quota_select(spark, sf):
    return sel.quota_select(v.bank(spark, sf), GROUPS)[0].select("pos", "sel_group")


@query("bank", SQL_QUOTA + """ SELECT 0 AS sel_group, 40 AS requested, (SELECT count(*) FROM g0) AS matched, (SELECT count(*) FROM s0) AS selected, 40 - (SELECT count(*) FROM s0) AS shortfall
    UNION ALL SELECT 1, 60, (SELECT count(*) FROM g1), (SELECT count(*) FROM s1), 60 - (SELECT count(*) FROM s1)""")
def selection_report(spark, sf):
    return sel.quota_select(v.bank(spark, sf), GROUPS)[1]


@query("bank scores", """, r0 AS (SELECT pos, score FROM scores WHERE grp IN (0, 2) ORDER BY score DESC, pos LIMIT 25),
    r1 AS (SELECT pos, score FROM scores WHERE grp IN (1, 2) AND pos NOT IN (SELECT pos FROM r0) ORDER BY score DESC, pos LIMIT 25)
    SELECT b.pos, r.g AS sel_group, round(r.score, 6) AS score, 'pending' AS status FROM (SELECT *, 0 AS g FROM r0 UNION ALL SELECT *, 1 FROM r1) r JOIN bank b USING (pos)""")
def score_quota_select(spark, sf):
    member = F.when(F.col("grp") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("grp").cast("int")))
    s = v.scores(spark, sf).select("pos", "score", member.alias("groups"), F.lit("fits").alias("reason"))
    picked, _ = sel.score_quota_select(v.bank(spark, sf), s, [{"count": 25}, {"count": 25}])
    return picked.select("pos", F.col("selection_review.group").alias("sel_group"), F.round("selection_review.score", 6).alias("score"), F.col("selection_review.status").alias("status"))


@query("bank scores", """SELECT s.pos, CASE WHEN b.pos IS NULL THEN 'unknown id' WHEN s.pos % 10 = 1 THEN 'score' ELSE 'reason' END AS error FROM scores s LEFT JOIN bank b USING (pos) WHERE b.pos IS NULL OR s.pos % 10 IN (1, 2)
    UNION ALL SELECT pos, 'no score' AS error FROM bank WHERE pos NOT IN (SELECT pos FROM scores)""")
def score_errors(spark, sf):
    p = F.col("pos") % 10
    s = v.scores(spark, sf).select(
        "pos", F.when(p == 1, 1.5).otherwise(F.col("score")).alias("score"), F.array(F.lit(0)).alias("groups"),
        F.when(p == 2, " ").otherwise("fits").alias("reason"),
    )
    return sel.score_errors(s, v.bank(spark, sf), 1).select("pos", "error")


def state_rows(spark, sf):
    """Bank rows with review state: figures are mentioned in every ninth row and confirmed in half of them."""
    p = F.col("pos")
    status = F.when(p % 8 == 5, "discarded").when(p % 8 == 6, "pending")
    return v.bank(spark, sf).select(
        "*", status.alias("status"), F.when(p % 2 == 0, "confirmed").alias("figure_status"), (p % 9 == 0).alias("suspected")
    )


SQL_STATE = """, st AS (SELECT *, CASE pos % 8 WHEN 5 THEN 'discarded' WHEN 6 THEN 'pending' END AS status, CASE WHEN pos % 2 = 0 THEN 'confirmed' ELSE '' END AS figure_status, pos % 9 = 0 AS suspected FROM bank),
    ps AS (SELECT *, coalesce(status, '') <> 'discarded' AND answer <> '' AND (flagged OR (suspected AND figure_status <> 'confirmed')) AS wait FROM st)"""


@query("bank", SQL_STATE + " SELECT pos, answer = '' AS is_missing, coalesce(status, '') = 'discarded' AS is_discarded, wait AS is_pending FROM ps")
def review_predicates(spark, sf):
    s = state_rows(spark, sf)
    return s.select(
        "pos", pr.missing("answer").alias("is_missing"), pr.discarded("status").alias("is_discarded"),
        pr.pending("status", "answer", "review_flags", F.col("suspected"), "figure_status").alias("is_pending"),
    )


@query("bank", "SELECT pos, pos % 6 = 0 OR flagged AS figure FROM bank")
def suspected_figure(spark, sf):
    stem = F.when(F.col("pos") % 6 == 0, F.concat(F.lit("如图所示，"), "stem")).otherwise(F.col("stem"))
    return v.bank(spark, sf).select("pos", pr.suspected_figure(stem, pr.filled("review_flags")).alias("figure"))
