"""DuckDB forms of the derived tables, put into oracle queries as WITH clauses."""
from __future__ import annotations

VIEWS = {
    "graded": """SELECT d.doc_id, d.source, d.lang, string_split(d.text, chr(10)) AS ln,
        CASE l.quality WHEN 1 THEN 'T' WHEN 0 THEN 'F' ELSE '' END AS answer, coalesce(l.toxic, 0) = 1 AS flagged
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "bank": """SELECT doc_id AS pos, ln[1] AS stem, list_slice(ln, 2, 5) AS options, answer,
        array_to_string(list_slice(ln, 6, len(ln)), chr(10)) AS remark, '' AS image, lang AS tag,
        source AS source_file, flagged FROM graded""",
    "items": """SELECT doc_id AS pos, CASE WHEN src % 2 = 0 THEN 'question' ELSE 'solution' END AS kind, source AS source_file,
        concat('paper', CAST(src // 2 AS VARCHAR)) AS grp,
        CASE WHEN src % 2 = 0 AND doc_id % 5 = 0 THEN 'S' ELSE '' END AS section,
        CASE WHEN doc_id % 17 = 3 THEN '' WHEN doc_id % 23 = 5 AND seq > 1 THEN CAST(seq - 1 AS VARCHAR)
             ELSE CAST(seq AS VARCHAR) END AS number,
        (seq - 1) // 4 + 1 AS page,
        CASE WHEN doc_id % 7 = 0 THEN [(seq - 1) // 4 + 1, (seq - 1) // 4 + 2] ELSE [(seq - 1) // 4 + 1] END AS source_pages,
        ln[1] AS stem, list_slice(ln, 2, 5) AS options, answer,
        array_to_string(list_slice(ln, 6, len(ln)), chr(10)) AS explanation, doc_id % 19 <> 4 AS complete
        FROM (SELECT *, CAST(substr(source, 4) AS INT) AS src, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq FROM graded)""",
    "docs": """SELECT source AS id, CASE WHEN src % 2 = 0 THEN 'questions' ELSE 'solutions' END AS role,
        concat('Paper ', CASE WHEN src >= 18 THEN 8 ELSE src // 2 END, CASE WHEN src % 2 = 1 THEN ' 答案' ELSE '' END) AS title,
        n AS last_question_number, src NOT IN (6, 7) AS continuous_numbering, (n - 1) // 4 + 1 AS pages,
        concat('paper', CAST(src // 2 AS VARCHAR)) AS grp
        FROM (SELECT source, CAST(substr(source, 4) AS INT) AS src, count(*) AS n FROM documents GROUP BY source)""",
    "page_roles": """SELECT conv_id AS doc, turn + 1 AS page, CASE WHEN conv_id % 7 = 0
        THEN CASE WHEN role = 'user' THEN 'questions' ELSE 'solutions' END
        WHEN turn <= conv_id % 4 THEN 'questions' ELSE 'solutions' END AS role FROM conversations""",
    "readings": """SELECT i.pos, i.source_file, i.page, i.number, i.answer, i.options, v.view,
        concat(CASE WHEN i.pos % 2 = 0 THEN 'T' ELSE 'F' END,
               CASE WHEN i.pos % 3 = 0 OR (v.view = 'contrast' AND i.pos % 11 = 4) THEN 'T' ELSE 'F' END,
               CASE WHEN i.pos % 5 = 0 THEN 'T' ELSE 'F' END, CASE WHEN i.pos % 13 = 7 THEN '?' ELSE 'T' END) AS characters,
        i.pos % 19 <> 6 AS complete
        FROM items i CROSS JOIN (SELECT 'raw' AS view UNION ALL SELECT 'contrast' AS view) v WHERE i.kind = 'question'""",
    "usage": """SELECT conv_id AS session, role AS task, turn AS ts, CASE WHEN role <> 'assistant' THEN length(text) END AS prompt_tokens,
        CASE WHEN role = 'assistant' THEN length(text) END AS completion_tokens,
        CASE WHEN turn % 3 = 0 THEN length(text) END AS total_tokens FROM conversations""",
    "progress_events": """SELECT event_id, ts, user_id % 5 AS session, event_type AS stage, user_id AS file,
        least(1.0::DOUBLE, value / 100.0::DOUBLE) AS fraction FROM events""",
    "files": """SELECT page_id AS ord, url AS path, html AS content, length(html) AS size, page_id AS mtime FROM pages
        UNION ALL SELECT page_id + 100000, concat('zz-copy/', url), html, length(html), page_id + 100000 FROM pages WHERE page_id % 10 = 0""",
    "scores": """SELECT vec_id AS pos, label % 3 AS grp,
        least(1.0::DOUBLE, greatest(0.0::DOUBLE, (1 + CAST(embedding[1] AS DOUBLE)) / 2)) AS score FROM embeddings""",
    "decisions": """SELECT event_id, user_id AS pos, CASE event_type WHEN 'click' THEN 'accepted' WHEN 'error' THEN 'discarded' WHEN 'view' THEN 'pending' ELSE event_type END AS decision, ts FROM events""",
}
NEEDS = {"bank": ["graded"], "items": ["graded"], "readings": ["graded", "items"]}


def with_views(names: str, sql: str) -> str:
    """``sql`` behind the named views and what they need. Further CTEs may open ``sql`` with a comma."""
    wanted: list[str] = []
    for name in names.split():
        for v in [*NEEDS.get(name, []), name]:
            if v not in wanted:
                wanted.append(v)
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in wanted)
    return f"WITH {head}\n{sql}" if head else sql
