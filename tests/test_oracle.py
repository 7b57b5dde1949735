"""Every registered query against its oracle SQL on the smallest tables."""
import duckdb
import pytest

import __spark_entry__ as entry
from itembank.plans.registry import ORACLE, QUERIES
from tools.check_oracle import TABLES, norm


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r["rule"] for r in rows} <= {"missing_answer", "answer_conflict", "duplicate_stem"}


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLE) == {"near_duplicates", "pack_lines"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def test_pack_lines_keeps_every_line(spark, sf):
    """The units of a document, joined, are its lines; every unit but the last is full."""
    from pyspark.sql import functions as F

    from itembank.operators import documents as dc
    from itembank.sources import views as v

    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    units = dc.pack_lines(docs.select("doc_id", F.split("text", "\n").alias("lines")), size=700).collect()
    by_doc = {}
    for u in sorted(units, key=lambda u: (u["doc_id"], u["page"])):
        by_doc.setdefault(u["doc_id"], []).append(u["text"])
    for row in docs.collect():
        packed = by_doc[row["doc_id"]]
        assert "".join(packed).rstrip("\n") == row["text"].rstrip("\n")
        assert all(len(t) >= 700 for t in packed[:-1])
