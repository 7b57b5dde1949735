"""Registered queries of documents, linking, numbering and readings."""
from __future__ import annotations

from pyspark.sql import functions as F

from itembank.functions import predicates as pr
from itembank.functions import text as tx
from itembank.operators import documents as dc
from itembank.operators import link as lk
from itembank.operators import review as rv
from itembank.plans.registry import query
from itembank.session import cut_lineage
from itembank.sources import views as v


@query("files", """, h AS (SELECT ord, path, size, sha256(content) AS sha256 FROM files)
    SELECT ord, path, sha256, substr(sha256(path), 1, 16) AS id, count(*) OVER (PARTITION BY sha256) AS copies,
    CASE WHEN path <> min(path) OVER (PARTITION BY sha256) THEN substr(sha256(min(path) OVER (PARTITION BY sha256)), 1, 16) END AS duplicate_of FROM h""")
def inventory(spark, sf):
    return dc.inventory(v.files(spark, sf)).select("ord", "path", "sha256", "id", "copies", "duplicate_of")


@query("files", """, h AS (SELECT ord, path, size, sha256(content) AS s FROM files), p AS (SELECT s, arg_min(size % 40, path) AS pages, arg_min(CASE WHEN size % 2 = 0 THEN 'questions' ELSE 'solutions' END, path) AS role FROM h GROUP BY s)
    SELECT ord, CASE WHEN path LIKE 'zz-copy/%' OR TRUE THEN p.pages END AS pages, p.role FROM h JOIN p USING (s)""")
def inherit_duplicates(spark, sf):
    inv = dc.inventory(v.files(spark, sf))
    primary = F.col("duplicate_of").isNull()
    mapped = inv.withColumn("pages", F.when(primary, F.col("size") % 40)).withColumn(
        "role", F.when(primary, F.when(F.col("size") % 2 == 0, "questions").otherwise("solutions"))
    )
    return dc.inherit_duplicates(mapped).select("ord", "pages", "role")


@query("", """WITH u AS (SELECT doc_id, text, unnest(range(0, length(text), 4500)) AS s FROM documents)
    SELECT doc_id, s // 4500 + 1 AS page, sha256(substr(text, s + 1, 4500)) AS chunk FROM u""")
def chunk_text(spark, sf):
    return dc.chunk_text(v.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "page", F.sha2("text", 256).alias("chunk"))


@query()
def pack_lines(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return dc.pack_lines(d).select("doc_id", "page", F.length("text").alias("chars"), F.sha2("text", 256).alias("unit"))


def stored_items(spark, sf, *columns):
    """Items as the stage table they are in a run: written once, then read by every branch of a plan."""
    return cut_lineage(v.items(spark, sf).select(*columns))


KEY_COLUMNS = ("pos", "kind", "source_file", "section", "number", "source_pages", "page")
LINK_COLUMNS = (*KEY_COLUMNS, "grp", "answer", "explanation", "complete")


SQL_UNITS = "WITH u AS (SELECT doc_id, unnest(range(1, (length(text) + 899) // 900 + 1)) AS page, (length(text) + 899) // 900 AS n FROM documents)"


def _units(spark, sf):
    return dc.chunk_text(v.table(spark, sf, "documents").select("doc_id", "text"), size=900).select("doc_id", "page")


@query("", SQL_UNITS + " SELECT doc_id, page FROM u WHERE page = 1 OR page > n - 3")
def sample_units_plan(spark, sf):
    return dc.sample_units(_units(spark, sf), "plan")


@query("", SQL_UNITS + " SELECT doc_id, page FROM u WHERE page IN (1, least(2, n), greatest(1, n // 2), greatest(1, n - 2), greatest(1, n - 1), n)")
def sample_units_inventory(spark, sf):
    return dc.sample_units(_units(spark, sf), "inventory")


@query("", SQL_UNITS + """, b AS (SELECT doc_id, unnest(range(0, (n + 2) // 3)) AS batch FROM (SELECT DISTINCT doc_id, n FROM u))
    SELECT u.doc_id, b.batch, u.page, (u.page - 1) // 3 = b.batch AS owned FROM u JOIN b ON u.doc_id = b.doc_id AND u.page BETWEEN b.batch * 3 AND b.batch * 3 + 4""")
def overlapping_batches(spark, sf):
    return dc.overlapping_batches(_units(spark, sf), 3).select("doc_id", "batch", "page", "owned")


@query("items", "SELECT pos, (source_pages[1] - 1) // 2 AS batch FROM items")
def owned_items(spark, sf):
    i = v.items(spark, sf)
    reported = i.withColumn("batch", F.explode(F.array(*[F.floor((F.col("page") - 1) / 2) + d for d in (-1, 0, 1)])))
    return dc.owned_items(reported, 2).select("pos", "batch")


@query("docs", """, k AS (SELECT *, regexp_replace(replace(title, '答案', ''), '\\s+', '', 'g') AS t FROM docs),
    q AS (SELECT k.*, (SELECT count(*) FROM k s WHERE s.role = 'solutions' AND s.t = k.t AND s.last_question_number = k.last_question_number) AS ns,
      (SELECT min(id) FROM k s WHERE s.role = 'solutions' AND s.t = k.t AND s.last_question_number = k.last_question_number) AS sid,
      (SELECT count(*) FROM k c WHERE c.role = 'questions' AND c.t = k.t) AS nq FROM k WHERE role = 'questions'),
    m AS (SELECT id, sid FROM q WHERE ns = 1 AND nq = 1)
    SELECT k.id, coalesce(a.sid, b.id, '') AS related_id, CASE WHEN a.sid IS NOT NULL OR b.id IS NOT NULL THEN 'matched' WHEN q.ns > 0 THEN 'needs_review' ELSE 'unpaired' END AS relationship_status,
    coalesce(b.id, k.id) AS paper_id FROM k LEFT JOIN m a ON a.id = k.id LEFT JOIN m b ON b.sid = k.id LEFT JOIN q ON q.id = k.id""")
def link_documents(spark, sf):
    return dc.link_documents(v.docs(spark, sf)).select("id", F.coalesce("related_id", F.lit("")).alias("related_id"), "relationship_status", "paper_id")


def _segments(docs):
    """Every question paper carries solutions on its last fifth; a second, overlapping segment loses."""
    p = F.col("pages")
    cut = F.greatest(F.lit(1), F.floor(p * 4 / 5).cast("int"))
    q = docs.filter("role = 'questions'").select("id", "pages", cut.alias("cut"))
    seg = lambda o, role, a, b: F.struct(F.lit(o).alias("ordinal"), F.lit(role).alias("role"), a.alias("start_page"), b.alias("end_page"))
    rows = F.array(seg(0, "solutions", F.col("cut"), p), seg(1, "questions", F.lit(1), p))
    return q.select("id", F.explode(rows).alias("s")).select("id", "s.*")


@query("items docs", """, s AS (SELECT id, greatest(1, pages * 4 // 5) AS cut, pages FROM docs WHERE role = 'questions')
    SELECT i.pos, i.page, coalesce(CASE WHEN s.id IS NULL THEN NULL WHEN i.page BETWEEN s.cut AND s.pages THEN 'solutions' WHEN i.page BETWEEN 1 AND s.pages THEN 'questions' END, d.role, 'unknown') AS page_role
    FROM items i LEFT JOIN s ON s.id = i.source_file LEFT JOIN docs d ON d.id = i.source_file""")
def page_role(spark, sf):
    d = v.docs(spark, sf)
    return dc.page_role(stored_items(spark, sf, "pos", "source_file", "page"), d, _segments(d)).select("pos", "page", "page_role")


@query("items docs", """, s AS (SELECT id, greatest(1, pages * 4 // 5) AS cut, pages FROM docs WHERE role = 'questions'),
    p AS (SELECT pos, source_file, unnest(source_pages) AS page FROM items),
    r AS (SELECT p.pos, bool_and(coalesce(CASE WHEN s.id IS NULL THEN NULL WHEN p.page BETWEEN s.cut AND s.pages THEN 'solutions' WHEN p.page BETWEEN 1 AND s.pages THEN 'questions' END, d.role, 'unknown') IN ('solutions', 'mixed', 'unknown')) AS ok
      FROM p LEFT JOIN s ON s.id = p.source_file LEFT JOIN docs d ON d.id = p.source_file GROUP BY p.pos)
    SELECT pos, CASE WHEN ok THEN answer ELSE '' END AS answer, CASE WHEN NOT ok AND answer <> '' THEN answer ELSE '' END AS rejected, ok AS authorized FROM items JOIN r USING (pos) WHERE ok OR kind <> 'solution'""")
def sanitize(spark, sf):
    d = v.docs(spark, sf)
    i = stored_items(spark, sf, "pos", "kind", "source_file", "source_pages", "answer", "explanation")
    return dc.sanitize(i, d, _segments(d)).select("pos", "answer", F.coalesce("rejected_answer", F.lit("")).alias("rejected"), "authorized")


@query("page_roles", """, d AS (SELECT doc, max(CASE WHEN role = 'questions' THEN page END) AS lq, min(CASE WHEN role = 'solutions' THEN page END) AS fs, max(page) AS pages FROM page_roles GROUP BY doc)
    SELECT doc, 0 AS ordinal, 'questions' AS role, 1 AS start_page, fs - 1 AS end_page, 'boundary_checked' AS status FROM d WHERE lq + 1 = fs
    UNION ALL SELECT doc, 1, 'solutions', fs, pages, 'boundary_checked' FROM d WHERE lq + 1 = fs
    UNION ALL SELECT doc, 0, CASE WHEN fs IS NULL THEN 'questions' ELSE 'solutions' END, 1, pages, 'sampled' FROM d WHERE lq IS NULL OR fs IS NULL
    UNION ALL SELECT doc, -1, '', 0, 0, 'needs_review' FROM d WHERE lq + 1 <> fs""")
def infer_segments(spark, sf):
    inferred = dc.infer_segments(v.page_roles(spark, sf))
    rows = inferred.select("doc", F.col("segment_status").alias("status"), F.posexplode_outer("segments").alias("ordinal", "s"))
    return rows.select(
        "doc", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), F.coalesce("s.role", F.lit("")).alias("role"),
        F.coalesce("s.start_page", F.lit(0)).alias("start_page"), F.coalesce("s.end_page", F.lit(0)).alias("end_page"), "status",
    )


def _bank_with_images(spark, sf):
    """Every bank row refers to a page of the file table by number; numbers beyond it are missing files."""
    img = F.concat(F.lit("page-"), (F.col("pos") % 320).cast("string"))
    return v.bank(spark, sf).select("pos", img.alias("image"), F.array(img, F.concat(F.lit("page-"), (F.col("pos") % 7).cast("string"))).alias("images"))


@query("", """WITH r AS (SELECT doc_id % 320 AS n FROM documents UNION SELECT doc_id % 7 FROM documents)
    SELECT concat('page-', n) AS ref, CASE WHEN html IS NULL THEN '' ELSE sha256(html) END AS digest FROM r LEFT JOIN pages ON page_id = n""")
def asset_manifest(spark, sf):
    files = v.table(spark, sf, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("path"), F.sha2("html", 256).alias("sha256"))
    return dc.asset_manifest(_bank_with_images(spark, sf), files).select("ref", F.coalesce("digest", F.lit("")).alias("digest"))


@query("files", """, o AS (SELECT *, sum(size) OVER () - coalesce(sum(size) OVER (ORDER BY mtime, size, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM files)
    SELECT path, size FROM o WHERE rest > (SELECT sum(size) // 3 FROM files) OR mtime < 40""")
def retention(spark, sf):
    f = v.files(spark, sf).drop("content")
    total = f.agg(F.sum("size").alias("s")).first()["s"]  # the caller's byte budget: a third of the total
    return dc.retention(f, total // 3, 40).select("path", "size")


# --- linking ----------------------------------------------------------------------------------

SQL_MATCH = """, q AS (SELECT *, count(*) OVER (PARTITION BY grp, section, number) AS kc, count(*) OVER (PARTITION BY grp, number) AS nc FROM items WHERE kind = 'question'),
    s AS (SELECT * FROM items WHERE kind = 'solution' AND number <> ''),
    e AS (SELECT q.pos, count(s.pos) AS n, min(s.pos) AS sp FROM q LEFT JOIN s ON s.grp = q.grp AND s.section = q.section AND s.number = q.number AND q.number <> '' GROUP BY q.pos),
    l AS (SELECT q.pos, count(s.pos) AS n, min(s.pos) AS sp FROM q LEFT JOIN s ON s.grp = q.grp AND s.number = q.number AND q.number <> '' GROUP BY q.pos),
    h AS (SELECT q.*, CASE WHEN e.n > 0 THEN e.n WHEN q.nc = 1 AND l.n = 1 THEN 1 ELSE 0 END AS hits, CASE WHEN e.n > 0 THEN e.sp ELSE l.sp END AS sp, e.n > 0 AS ex FROM q JOIN e USING (pos) JOIN l USING (pos)),
    m AS (SELECT h.* EXCLUDE (answer), CASE WHEN hits = 1 AND kc = 1 THEN sp END AS solution_pos, h.answer AS own FROM h),
    f AS (SELECT m.*, s.answer AS s_answer, s.complete AS s_complete, s.source_file AS s_file, s.source_pages AS s_pages, CASE WHEN solution_pos IS NULL THEN own ELSE s.answer END AS answer FROM m LEFT JOIN s ON s.pos = m.solution_pos)"""


def _matched(spark, sf, *more):
    i = stored_items(spark, sf, *LINK_COLUMNS, *more)
    return lk.match_solutions(i.filter("kind = 'question'"), i.filter("kind = 'solution'"))


@query("items", SQL_MATCH + """ SELECT pos, coalesce(solution_pos, -1) AS solution_pos, answer, CASE WHEN solution_pos IS NULL THEN '' WHEN ex THEN 'exact' ELSE 'unique_number_in_linked_paper' END AS method,
    CASE WHEN solution_pos IS NOT NULL AND own <> '' AND own <> s_answer THEN own ELSE '' END AS replaced,
    concat_ws('|', CASE WHEN kc > 1 THEN '题号重复' END, CASE WHEN solution_pos IS NOT NULL AND NOT s_complete THEN '答案解析不完整' END, CASE WHEN solution_pos IS NULL AND hits >= 1 THEN '答案关联不唯一' END) AS flags FROM f""")
def match_solutions(spark, sf):
    return _matched(spark, sf).select(
        "pos", F.coalesce("solution_pos", F.lit(-1)).alias("solution_pos"), "answer", F.coalesce("match_method", F.lit("")).alias("method"),
        F.coalesce("replaced_answer", F.lit("")).alias("replaced"), F.array_join("link_flags", "|").alias("flags"),
    )


@query("items docs", """, d AS (SELECT * FROM docs WHERE continuous_numbering AND last_question_number >= 1 AND role = 'questions'),
    c AS (SELECT source_file, CAST(number AS BIGINT) AS n, count(*) AS cnt FROM items WHERE kind = 'question' AND number <> '' GROUP BY ALL),
    x AS (SELECT id AS source_file, unnest(range(1, last_question_number + 1)) AS n FROM d),
    m AS (SELECT source_file, n, n - row_number() OVER (PARTITION BY source_file ORDER BY n) AS run FROM x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.source_file = x.source_file AND c.n = x.n))
    SELECT source_file, min(n) AS n, max(n) AS to_n, 'missing' AS problem FROM m GROUP BY source_file, run
    UNION ALL SELECT source_file, n, n, 'duplicate' FROM c WHERE cnt > 1 AND source_file IN (SELECT id FROM d)""")
def coverage(spark, sf):
    return lk.coverage(stored_items(spark, sf, *KEY_COLUMNS), v.docs(spark, sf))


SQL_NEAR = """, d AS (SELECT id AS source_file, CASE role WHEN 'questions' THEN 'question' ELSE {solutions} END AS kind, last_question_number AS last, pages FROM docs WHERE continuous_numbering AND last_question_number >= 1),
    r AS (SELECT source_file, kind, pos, CAST(number AS BIGINT) AS n, list_min(source_pages) AS lo, list_max(source_pages) AS hi FROM items WHERE number <> ''),
    c AS (SELECT source_file, kind, n, count(*) AS cnt, min(lo) AS lo, max(hi) AS hi, arg_min(lo, pos) AS flo, arg_min(hi, pos) AS fhi FROM r GROUP BY ALL),
    x AS (SELECT source_file, kind, pages, unnest(range(1, last + 1)) AS n FROM d),
    t AS (SELECT x.*, coalesce(c.cnt, 0) AS cnt, c.lo, c.hi FROM x LEFT JOIN c USING (source_file, kind, n)),
    y AS (SELECT t.*,
      (SELECT arg_max(fhi, n) FROM c WHERE c.source_file = t.source_file AND c.kind = t.kind AND c.n < t.n) AS bhi,
      (SELECT arg_min(flo, n) FROM c WHERE c.source_file = t.source_file AND c.kind = t.kind AND c.n > t.n) AS alo,
      (SELECT min(lo) FROM (SELECT lo FROM r WHERE r.source_file = t.source_file AND r.kind = t.kind ORDER BY abs(r.n - t.n), r.pos LIMIT 2)) AS nlo,
      (SELECT max(hi) FROM (SELECT hi FROM r WHERE r.source_file = t.source_file AND r.kind = t.kind ORDER BY abs(r.n - t.n), r.pos LIMIT 2)) AS nhi FROM t WHERE cnt <> 1)"""
SQL_STATUS = """CASE WHEN first_page IS NULL THEN 'no_rows' WHEN last_page < first_page THEN 'no_pages' WHEN targets > {targets} THEN 'too_many_targets'
    WHEN last_page - first_page + 1 > {pages} THEN 'too_many_pages' ELSE 'ready' END AS status"""
#: Limits of the two rereading steps: numbers of a paper, pages of a span.
REREAD, RECOVER = (20, 6), (10, 6)


@query("items docs", SQL_NEAR.format(solutions="'solution'") + """, z AS (SELECT source_file, kind, n, cnt, CASE WHEN nlo IS NOT NULL THEN greatest(1, CASE WHEN cnt > 0 THEN lo WHEN bhi IS NOT NULL AND alo IS NOT NULL THEN least(bhi, alo) ELSE nlo END) END AS first_page,
      CASE WHEN nlo IS NOT NULL THEN least(pages, CASE WHEN cnt > 0 THEN hi WHEN bhi IS NOT NULL AND alo IS NOT NULL THEN greatest(bhi, alo) ELSE nhi END) END AS last_page, count(*) OVER (PARTITION BY source_file, kind) AS targets FROM y),
    i AS (SELECT *, CASE WHEN cnt > 0 THEN -n ELSE n - row_number() OVER (PARTITION BY source_file, kind, cnt ORDER BY n) END AS run FROM z)
    SELECT source_file, kind, min(n) AS n, max(n) AS to_n, first_page, last_page, """ + SQL_STATUS.format(targets=REREAD[0], pages=REREAD[1]) + """
    FROM i GROUP BY source_file, kind, cnt, run, first_page, last_page, targets""")
def coverage_worklist(spark, sf):
    return lk.coverage_worklist(stored_items(spark, sf, *KEY_COLUMNS), v.docs(spark, sf), *REREAD)


@query("items docs", SQL_NEAR.format(solutions="'question'") + """, z AS (SELECT source_file, n, CASE WHEN nlo IS NOT NULL THEN greatest(1, nlo - 1) END AS first_page, CASE WHEN nlo IS NOT NULL THEN least(pages, nhi + 1) END AS last_page, count(*) OVER (PARTITION BY source_file) AS targets FROM y WHERE cnt = 0)
    SELECT source_file, n, first_page, last_page, """ + SQL_STATUS.format(targets=RECOVER[0], pages=RECOVER[1]) + """ FROM z""")
def missing_worklist(spark, sf):
    spans = lk.missing_worklist(stored_items(spark, sf, *KEY_COLUMNS), v.docs(spark, sf), None, *RECOVER)
    return spans.select("source_file", F.explode(F.sequence("n", "to_n")).alias("n"), "first_page", "last_page", "status")


@query("items", """, k AS (SELECT pos, source_file, kind, section, number, source_pages FROM items WHERE number <> ''),
    p AS (SELECT DISTINCT a.source_file, a.kind, a.section, a.number FROM k a JOIN k b ON a.source_file = b.source_file AND a.kind = b.kind AND a.section = b.section AND a.number = b.number AND a.pos < b.pos AND list_has_any(a.source_pages, b.source_pages))
    SELECT k.pos, k.number FROM k JOIN p USING (source_file, kind, section, number)""")
def overlap_candidates(spark, sf):
    return lk.overlap_candidates(stored_items(spark, sf, *KEY_COLUMNS), ["source_file", "kind", "section", "number"]).select("pos", "number")


@query("items", """, k AS (SELECT pos, source_file, kind, section, number, source_pages FROM items WHERE number <> ''),
    p AS (SELECT DISTINCT a.source_file, a.kind, a.section, a.number FROM k a JOIN k b ON a.source_file = b.source_file AND a.kind = b.kind AND a.section = b.section AND a.number = b.number AND a.pos < b.pos AND list_has_any(a.source_pages, b.source_pages)),
    c AS (SELECT source_file, kind, section, number, min(k.pos) AS pos, count(*) AS n FROM k JOIN p USING (source_file, kind, section, number) GROUP BY ALL), g AS (SELECT * FROM c WHERE pos % 3 <> 0)
    SELECT i.pos, FALSE AS reconciled FROM items i WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.source_file = i.source_file AND g.kind = i.kind AND g.section = i.section AND g.number = i.number)
    UNION ALL SELECT pos, TRUE FROM g""")
def apply_reconciliation(spark, sf):
    keys = ["source_file", "kind", "section", "number"]
    i = stored_items(spark, sf, *KEY_COLUMNS)
    c = lk.overlap_candidates(i, keys).groupBy(*keys).agg(F.min("pos").alias("pos"))
    one = F.struct("pos", "kind", F.when(F.col("pos") % 3 == 0, "0").otherwise(F.col("number")).alias("number"))
    verdicts = c.select(*keys, F.lit(True).alias("same_question"), F.array(one).alias("merged"))
    return lk.apply_reconciliation(i, verdicts, keys).select("pos", "reconciled")


def _printed(spark, sf):
    """Printed answer lines: solutions as they stand, every 29th misread, every 31st one page on."""
    p = F.col("pos")
    s = v.items(spark, sf).filter("kind = 'solution' AND number <> ''")
    page = F.col("page") + F.when(p % 31 == 1, 9).otherwise(0)
    return s.select("source_file", page.alias("page"), F.concat("number", F.lit(".")).alias("number"), F.when(p % 29 == 1, "X").otherwise(F.col("answer")).alias("answer"))


@query("items", SQL_MATCH + """, pr AS (SELECT source_file, page + CASE WHEN pos % 31 = 1 THEN 9 ELSE 0 END AS page, number, CASE WHEN pos % 29 = 1 THEN 'X' ELSE answer END AS a FROM items WHERE kind = 'solution' AND number <> ''),
    ask AS (SELECT pos, answer, number, s_file, unnest(s_pages) AS page FROM f WHERE solution_pos IS NOT NULL AND answer <> ''),
    own AS (SELECT ask.pos, count(*) AS c, count(DISTINCT a) AS k, min(a) AS a FROM ask JOIN pr ON pr.source_file = s_file AND pr.page = ask.page AND pr.number = ask.number GROUP BY ask.pos),
    loc AS (SELECT source_file, number, count(DISTINCT page) AS np, min(page) AS page, count(DISTINCT a) AS k, min(a) AS a FROM pr GROUP BY ALL)
    SELECT f.pos, CASE WHEN own.c IS NULL AND loc.np = 1 THEN loc.page ELSE -1 END AS recovered_page,
    CASE WHEN own.c IS NOT NULL THEN CASE WHEN own.k = 1 AND own.a = f.answer THEN '' ELSE '答案复核不一致' END WHEN loc.np = 1 THEN CASE WHEN loc.k = 1 AND loc.a = f.answer THEN '' ELSE '答案复核不一致' END ELSE '答案未通过独立复核' END AS flag
    FROM f LEFT JOIN own USING (pos) LEFT JOIN loc ON loc.source_file = f.s_file AND loc.number = f.number WHERE solution_pos IS NOT NULL AND answer <> ''""")
def audit_answers(spark, sf):
    out = lk.audit_answers(cut_lineage(_matched(spark, sf)), _printed(spark, sf)).filter("audit_matches IS NOT NULL")
    return out.select("pos", F.coalesce("recovered_page", F.lit(-1)).alias("recovered_page"), F.coalesce("audit_flag", F.lit("")).alias("flag"))


@query("items", SQL_MATCH + """, w AS (SELECT *, CASE WHEN pos % 12 = 0 THEN '<uncertain>' ELSE '' END AS mark FROM f)
    SELECT pos, answer, concat_ws('|', CASE WHEN kc > 1 THEN '题号重复' END, CASE WHEN solution_pos IS NOT NULL AND NOT s_complete THEN '答案解析不完整' END, CASE WHEN solution_pos IS NULL AND hits >= 1 THEN '答案关联不唯一' END,
      CASE WHEN NOT complete THEN '跨页内容不完整' END, CASE WHEN pos % 12 = 0 THEN 'OCR 不确定' END, CASE WHEN answer = '' THEN '原文未提供答案' END,
      CASE WHEN pos % 8 = 0 AND answer <> '' AND len(options) > 0 AND length(answer) <> len(options) THEN '判断题答案数量与选项不符' END) AS flags, pos % 25 = 0 AS shared FROM w""")
def item_flags(spark, sf):
    p = F.col("pos")
    m = _matched(spark, sf, "stem", "options")
    stem = F.concat("stem", F.when(p % 12 == 0, "<uncertain>").otherwise(""), F.when(p % 8 == 0, "判断正误").otherwise(""))
    section = F.when(p % 25 == 0, F.lit("1-3 为题组：" + "材料" * 15)).otherwise(F.col("section"))
    out = rv.item_flags(m.withColumn("stem", stem).withColumn("section", section))
    return out.select("pos", "answer", F.array_join("review_flags", "|").alias("flags"), F.col("shared_material").alias("shared"))


@query("items", """, q AS (SELECT pos, source_file, section, number, pos % 4 = 0 AS owner, pos % 8 = 0 AS reviewed, CASE WHEN TRY_CAST(number AS BIGINT) IS NULL THEN '' ELSE CAST(CAST(number AS BIGINT) + 1 AS VARCHAR) END AS next FROM items WHERE kind = 'question')
    SELECT t.pos, CAST(t.owner AS INT) + (SELECT count(*) FROM q o WHERE o.owner AND o.reviewed AND o.source_file = t.source_file AND o.section = t.section AND o.next = t.number AND o.number <> '' AND o.pos <> t.pos) AS figures,
    t.owner AND NOT t.reviewed AND t.number <> '' AS sharing_unreviewed FROM q t""")
def share_figures(spark, sf):
    p = F.col("pos")
    nxt = F.when(F.col("number") != "", F.array((F.col("number").cast("int") + 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    fig = F.struct(
        F.col("page").alias("page"), F.array(p.cast("double")).alias("bbox"), nxt.alias("shared_with"), (p % 8 == 0).alias("sharing_reviewed"),
        F.lit(None).cast("string").alias("shared_from"),
    )
    q = v.items(spark, sf).filter("kind = 'question'").withColumn("source_hash", F.col("source_file"))
    kind = "array<struct<page:int,bbox:array<double>,shared_with:array<string>,sharing_reviewed:boolean,shared_from:string>>"
    q = q.withColumn("figures", F.when(p % 4 == 0, F.array(fig)).otherwise(F.array().cast(kind)))
    return lk.share_figures(q).select("pos", F.size("figures").alias("figures"), "sharing_unreviewed")


@query("items docs", """, g AS (SELECT DISTINCT grp FROM items WHERE kind = 'question'), d AS (SELECT grp, id, CASE WHEN grp IN ('paper1', 'paper4') AND role = 'solutions' THEN 'unknown' ELSE role END AS role FROM docs)
    SELECT d.grp, d.id AS file FROM d JOIN g USING (grp) WHERE role = 'solutions' UNION ALL SELECT d.grp, d.id FROM d JOIN g USING (grp) WHERE role = 'unknown' AND d.grp NOT IN (SELECT grp FROM d WHERE role = 'solutions')""")
def recovery_sources(spark, sf):
    d = v.docs(spark, sf)
    d = d.withColumn("role", F.when(F.col("grp").isin("paper1", "paper4") & (F.col("role") == "solutions"), "unknown").otherwise(F.col("role")))
    return lk.recovery_sources(v.items(spark, sf).filter("kind = 'question'"), d)


@query("items", """, f AS (SELECT pos + 1000000 AS pos, source_file, kind, number FROM items WHERE page % 5 = 0 AND number <> '' QUALIFY row_number() OVER (PARTITION BY source_file, kind, number ORDER BY pos) = 1)
    SELECT pos FROM f UNION ALL SELECT pos FROM items i WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.source_file = i.source_file AND f.kind = i.kind AND f.number = i.number)""")
def replace_rows(spark, sf):
    i = stored_items(spark, sf, *KEY_COLUMNS)
    first = i.filter("page % 5 = 0 AND number <> ''").groupBy("source_file", "kind", "number").agg((F.min("pos") + 1000000).alias("pos"))
    return lk.replace_rows(i, first).select("pos")


# --- validation and readings ------------------------------------------------------------------

@query("items", """, i AS (SELECT pos, page, stem, CASE WHEN pos % 31 = 7 THEN 'note' ELSE kind END AS kind, CASE WHEN pos % 29 = 3 THEN list_prepend(9999, source_pages) ELSE source_pages END AS sp, CASE WHEN pos % 37 = 5 THEN NULL ELSE complete END AS complete FROM items)
    SELECT pos, concat_ws('|', CASE WHEN kind = 'note' THEN 'kind' END, CASE WHEN list_contains(sp, 9999) THEN 'pages' END, CASE WHEN kind = 'question' AND trim(stem) = '' THEN 'blank stem' END, CASE WHEN complete IS NULL THEN 'complete' END) AS errors FROM i""")
def validate_items(spark, sf):
    return _validated(spark, sf).select("pos", F.array_join("errors", "|").alias("errors"))


def _validated(spark, sf):
    p, batch = F.col("pos"), F.floor((F.col("page") - 1) / 2).cast("int")
    i = v.items(spark, sf).select(
        "*", batch.alias("batch")
    ).withColumn("kind", F.when(p % 31 == 7, "note").otherwise(F.col("kind"))).withColumn(
        "source_pages", F.when(p % 29 == 3, F.concat(F.array(F.lit(9999)), "source_pages")).otherwise(F.col("source_pages"))
    ).withColumn("complete", F.when(p % 37 != 5, F.col("complete")))
    first = F.col("batch") * 2 + 1
    return rv.validate_items(i, F.sequence(first - 1, first + 2), F.array(first, first + 1))


@query("items", """, i AS (SELECT source_file, (page - 1) // 2 AS batch, pos % 31 = 7 OR pos % 29 = 3 OR pos % 37 = 5 OR (kind = 'question' AND trim(stem) = '') AS bad FROM items)
    SELECT source_file, batch, count(*) AS n_items, count_if(bad) AS bad_items, count_if(bad) = 0 AS ok FROM i GROUP BY ALL""")
def batch_verdicts(spark, sf):
    out = _validated(spark, sf).withColumn("key", F.struct("source_file", "batch"))
    return rv.batch_verdicts(out, "key").select("key.source_file", "key.batch", "n_items", "bad_items", "ok")


def _review_batch(spark, sf):
    """Six questions of a source per review batch."""
    q = stored_items(spark, sf, "pos", "kind", "source_file", "stem", "options").filter("kind = 'question'")
    return q.select(F.concat_ws("-", "source_file", F.floor((F.col("pos") / 120)).cast("string")).alias("batch_id"), F.col("pos").cast("string").alias("id"), "pos", "stem", "options")


SQL_FINDINGS = """, q AS (SELECT concat(source_file, '-', pos // 120) AS b, pos, stem, pos % 6 AS m FROM items WHERE kind = 'question'), bad AS (SELECT DISTINCT b FROM q WHERE pos % 41 = 0)"""


@query("items", SQL_FINDINGS + " SELECT b AS batch_id, CAST(pos AS VARCHAR) AS id, CASE WHEN b IN (SELECT b FROM bad) OR m = 1 OR m = 2 THEN 'unresolved' ELSE 'checked' END AS status FROM q")
def validate_findings(spark, sf):
    return _findings(spark, sf)[1]


@query("items", SQL_FINDINGS + " SELECT b AS batch_id, CAST(pos AS VARCHAR) AS id, 'stem' AS field FROM q WHERE m IN (3, 4) AND b NOT IN (SELECT b FROM bad)")
def text_risks(spark, sf):
    return _findings(spark, sf)[0].select("batch_id", "id", "field")


def _findings(spark, sf):
    q = _review_batch(spark, sf)
    m = F.col("pos") % 6
    # An envelope that echoes another id covers nothing; a sixth of the rows is left out of it.
    envelopes = q.groupBy("batch_id").agg(
        F.max(F.col("pos") % 41 == 0).alias("__wrong"), F.max(F.when(F.col("pos") % 41 == 0, "x").otherwise("")).alias("__x"),
        F.collect_list(F.when(m != 1, F.col("id"))).alias("reviewed_ids"),
    ).select("batch_id", F.concat("batch_id", "__x").alias("returned_id"), F.lit("completed").alias("status"), "reviewed_ids")
    quote = F.when(m == 2, "not in the text at all").otherwise(F.col("stem"))
    found = q.filter(m.isin(2, 3, 4)).select("batch_id", "id", F.lit("stem").alias("field"), quote.alias("quote"), F.lit("r").alias("reason"), F.lit(1).alias("ord"))
    return rv.validate_findings(envelopes, found, q.select("batch_id", "id", "stem", "options"))


def _crop_readings(spark, sf):
    r = v.readings(spark, sf)
    return r.select("pos", "page", F.lit("line").alias("crop"), "view", "number", F.col("number").alias("asked"), F.lit(0).alias("n_options"), "characters", "complete", (F.col("pos") % 43 == 0).alias("duplicated"))


@query("readings", "SELECT pos, view, CASE WHEN complete AND regexp_full_match(characters, '[TF]+') THEN characters ELSE '' END AS value FROM readings")
def valid_readings(spark, sf):
    out = rv.valid_readings(_crop_readings(spark, sf), ["pos", "view"])
    return out.select("pos", "view", F.coalesce("value", F.lit("")).alias("value"))


@query("readings", """, x AS (SELECT pos, any_value(answer) AS old, max(CASE WHEN view = 'raw' AND complete AND regexp_full_match(characters, '[TF]+') THEN characters END) AS a,
      max(CASE WHEN view = 'contrast' AND complete AND regexp_full_match(characters, '[TF]+') THEN characters END) AS b FROM readings GROUP BY pos),
    t AS (SELECT *, (pos % 6 <> 0 OR regexp_full_match(old, '[TF]+')) AND pos % 9 <> 0 AS target FROM x),
    y AS (SELECT *, target AND coalesce(a = b AND pos % 43 <> 0, FALSE) AS ok FROM t)
    SELECT pos, CASE WHEN ok THEN a ELSE old END AS answer, CASE WHEN ok THEN '' WHEN target THEN '答案复核不一致|答案局部放大未通过复核' ELSE '答案复核不一致' END AS flags, ok AS confirmed FROM y""")
def answer_consensus(spark, sf):
    p = F.col("pos")
    file = F.when(p % 9 == 0, "notes.txt").otherwise("Paper.PDF")
    q = v.items(spark, sf).filter("kind = 'question'").select(
        "pos", "answer", F.lit("").alias("stem"), F.when(p % 6 != 0, "true_false").alias("answer_format"), F.struct(file.alias("source_file")).alias("answer_source"),
        F.array(F.lit(lk.FLAG_AUDIT_DIFFERS)).alias("review_flags"))
    out = rv.answer_consensus(q, _crop_readings(spark, sf))
    return out.select("pos", "answer", F.array_join("review_flags", "|").alias("flags"), F.col("zoom_confirmed").alias("confirmed"))


@query("items", """, q AS (SELECT pos, grp, answer, pos % 10 <> 3 AS quoted, pos % 10 = 4 AS clash, pos % 10 <> 5 AS again FROM items WHERE kind = 'question'),
    a AS (SELECT *, answer = '' AND pos % 13 <> 0 AS asked FROM q),
    v AS (SELECT *, asked AND quoted AND again AND NOT clash AND grp <> 'paper3' AS filled FROM a)
    SELECT pos, CASE WHEN filled THEN 'T' ELSE answer END AS answer, CASE WHEN NOT asked THEN '' WHEN filled THEN 'recovered' ELSE 'unresolved' END AS recovery, CASE WHEN filled THEN 0 ELSE 1 END AS flags FROM v""")
def recover_answers(spark, sf):
    p = F.col("pos")
    q = stored_items(spark, sf, "pos", "kind", "grp", "stem", "options", "answer").filter("kind = 'question'").select(
        "pos", "grp", "stem", "options", "answer", F.lit(None).cast("string").alias("status"), (p % 13 == 0).alias("tried"),
        F.array(F.lit(pr.NO_ANSWER_FLAG)).alias("review_flags"),
    )
    quote = F.when(p % 10 == 3, "12.").otherwise("12. T F")
    base = q.select("pos", F.lit("key.pdf").alias("source_file"), F.lit(1).alias("page"), F.lit("T").alias("answer"), quote.alias("quote"), F.lit(True).alias("page_ok"))
    clash = q.filter(p % 10 == 4).select("pos", F.lit("key.pdf").alias("source_file"), F.lit(2).alias("page"), F.lit("F").alias("answer"), F.lit("12. T F").alias("quote"), F.lit(True).alias("page_ok"))
    cand = base.unionByName(clash)
    checks = cand.select("pos", "source_file", "page", F.lit(True).alias("matches"), F.when(p % 10 == 5, "F").otherwise(F.col("answer")).alias("answer"))
    errors = q.filter("grp = 'paper3'").select("grp")
    out = rv.recover_answers(q, cand, checks, errors)
    return out.select("pos", "answer", F.coalesce("recovery", F.lit("")).alias("recovery"), F.size("review_flags").alias("flags"))
