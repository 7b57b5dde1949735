"""Question-bank shaped tables derived from the given parquet tables.

Every view keeps all rows and the whole text: a document's first line is the
stem, lines 2–5 are options, the rest is the remark or explanation.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.operators.ordered import row_numbers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    lines = F.split("text", "\n")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "source", "lang",
        lines[0].alias("stem"),
        F.slice(lines, 2, 4).alias("options"),
        F.array_join(F.slice(lines, F.lit(6), F.greatest(F.size(lines) - 5, F.lit(0))), "\n").alias("remark"),
        F.when(F.col("quality") == 1, "T").when(F.col("quality") == 0, "F").otherwise("").alias("answer"),
        (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("flagged"),
    )


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank rows: repeated first lines, missing answers, a few conflicting groups."""
    return _graded(spark, sf_dir).select(
        F.col("doc_id").alias("pos"), "stem", "options", "answer", "remark",
        F.lit("").alias("image"), F.col("lang").alias("tag"), F.array("lang").alias("category_tags"),
        F.col("source").alias("source_file"), "flagged",
        F.when(F.col("flagged"), F.array(F.lit("答案冲突"))).otherwise(F.array().cast("array<string>")).alias("review_flags"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted items of ten papers: questions in even sources, solutions in odd ones."""
    src = F.substring("source", 4, 10).cast("int")
    g = row_numbers(_graded(spark, sf_dir), ["source"], "doc_id", "seq")
    question = src % 2 == 0
    doc = F.col("doc_id")
    page = (F.floor((F.col("seq") - 1) / 4) + 1).cast("int")
    return g.select(
        doc.alias("pos"),
        F.when(question, "question").otherwise("solution").alias("kind"),
        F.col("source").alias("source_file"),
        F.concat(F.lit("paper"), F.floor(src / 2).cast("string")).alias("grp"),
        F.when(question & (doc % 5 == 0), "S").otherwise("").alias("section"),
        F.when(doc % 17 == 3, "")
        .when((doc % 23 == 5) & (F.col("seq") > 1), (F.col("seq") - 1).cast("string"))
        .otherwise(F.col("seq").cast("string")).alias("number"),
        page.alias("page"),
        F.when(doc % 7 == 0, F.array(page, (page + 1).cast("int"))).otherwise(F.array(page)).alias("source_pages"),
        "stem", "options", "answer", F.col("remark").alias("explanation"),
        (doc % 19 != 4).alias("complete"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document map rows: roles, titles with an answer word, one colliding title."""
    src = F.substring("source", 4, 10).cast("int")
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    paper = F.when(src >= 18, F.lit(8)).otherwise(F.floor(src / 2).cast("int"))
    return n.select(
        F.col("source").alias("id"),
        F.when(src % 2 == 0, "questions").otherwise("solutions").alias("role"),
        F.concat(F.lit("Paper "), paper.cast("string"), F.when(src % 2 == 1, F.lit(" 答案")).otherwise("")).alias("title"),
        F.col("n").cast("int").alias("last_question_number"),
        (~src.isin(6, 7)).alias("continuous_numbering"),
        (F.floor((F.col("n") - 1) / 4) + 1).cast("int").alias("pages"),
        F.concat(F.lit("paper"), F.floor(src / 2).cast("string")).alias("grp"),
    )


def page_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role per page of a conversation; every seventh document interleaves."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        conv.alias("doc"), (turn + 1).alias("page"),
        F.when(conv % 7 == 0, F.when(F.col("role") == "user", "questions").otherwise("solutions"))
        .when(turn <= conv % 4, "questions").otherwise("solutions").alias("role"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two independent readings per question; some disagree, some are unreadable or incomplete."""
    pos = F.col("pos")
    q = items(spark, sf_dir).filter("kind = 'question'").select("pos", "source_file", "page", "number", "options", "answer")
    pick = lambda cond: F.when(cond, "T").otherwise("F")
    return q.select("*", F.explode(F.array(F.lit("raw"), F.lit("contrast"))).alias("view")).select(
        "*",
        F.concat(
            pick(pos % 2 == 0),
            pick((pos % 3 == 0) | ((F.col("view") == "contrast") & (pos % 11 == 4))),
            pick(pos % 5 == 0),
            F.when(pos % 13 == 7, "?").otherwise("T"),
        ).alias("characters"),
        (pos % 19 != 6).alias("complete"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model usage rows with missing fields."""
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"), F.col("role").alias("task"), F.col("turn").alias("ts"),
        F.when(F.col("role") != "assistant", n).alias("prompt_tokens"),
        F.when(F.col("role") == "assistant", n).alias("completion_tokens"),
        F.when(F.col("turn") % 3 == 0, n).alias("total_tokens"),
    )


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", (F.col("user_id") % 5).alias("session"), F.col("event_type").alias("stage"),
        F.col("user_id").alias("file"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("fraction"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File inventory; every tenth file has an exact copy under another path."""
    pages = table(spark, sf_dir, "pages")
    row = lambda df, shift, prefix: df.select(
        (F.col("page_id") + shift).alias("ord"), F.concat(F.lit(prefix), "url").alias("path"),
        F.col("html").alias("content"), F.length("html").alias("size"), (F.col("page_id") + shift).alias("mtime"),
    )
    return row(pages, 0, "").unionByName(row(pages.filter(F.col("page_id") % 10 == 0), 100000, "zz-copy/"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in [0, 1] and a group per row."""
    first = F.get(F.col("embedding"), F.lit(0)).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pos"), (F.col("label") % 3).alias("grp"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 + first) / 2)).alias("score"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review decision log: three kinds of events are decisions; the others are there under their own names."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("pos"),
        F.when(kind == "click", "accepted").when(kind == "error", "discarded").when(kind == "view", "pending").otherwise(kind).alias("decision"),
        "ts",
    )
