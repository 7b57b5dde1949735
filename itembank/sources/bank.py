"""Reading banks and documents, writing bundles."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itembank.operators.documents import asset_manifest
from itembank.operators.skew import attach_per_key

SUFFIXES = (".pdf", ".docx", ".txt", ".md", ".json")

FIGURE = "struct<page:int,bbox:array<double>,caption:string,shared_with:array<string>,sharing_reviewed:boolean,shared_from:string>"
BANK_SCHEMA = (
    "stem string, options array<string>, answer string, explanation string, remark string, image string, "
    "images array<string>, category_tags array<string>, number string, original_number string, section string, "
    f"source_file string, source_pages array<int>, figures array<{FIGURE}>, review_flags array<string>, "
    "agent_source struct<source_file:string,source_hash:string,source_pages:array<int>,number:string,section:string>, agent_run string"
)


def read_bank(spark: SparkSession, path: str, schema: str = BANK_SCHEMA) -> DataFrame:
    """JSON banks: each file an array of questions or an object holding them. ``file_pos`` is the place in the file,
    ``pos`` the place in all files in order of their paths, so it is unique and dense.

    A JSON array is one document and is parsed by one task; a folder of files is read in parallel.
    Larger banks come as JSON lines or Parquet, see ``read_bank_table``. A row without a string stem
    fails the read.
    """
    text = spark.read.text(path, wholetext=True).select(
        F.regexp_replace("value", "^﻿", "").alias("v"), F.col("_metadata.file_path").alias("bank_file")
    )
    doc = text.select(F.try_parse_json("v").alias("d"), "bank_file")
    rows = doc.select(
        "bank_file", F.coalesce(F.try_variant_get("d", "$", "array<variant>"), F.try_variant_get("d", "$.questions", "array<variant>")).alias("qs")
    )
    checked = rows.select("bank_file", F.when(F.col("qs").isNull(), F.raise_error(F.lit("not a question bank"))).otherwise(F.col("qs")).alias("qs"))
    # One row per file: how many questions the files before it hold.
    lengths = rows.select("bank_file", F.coalesce(F.size("qs"), F.lit(0)).cast("long").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("bank_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = lengths.select(F.col("bank_file").alias("__file"), before.alias("__before"))
    placed = checked.join(offsets, F.col("bank_file") == F.col("__file"))
    each = placed.select("bank_file", "__before", F.posexplode("qs").alias("file_pos", "q"))
    stem_type = F.schema_of_variant(F.try_variant_get("q", "$.stem", "variant"))
    guarded = each.select(
        "bank_file", (F.col("__before") + F.col("file_pos")).alias("pos"), F.col("file_pos").cast("long").alias("file_pos"),
        F.when(F.coalesce(stem_type == "STRING", F.lit(False)), F.to_json("q")).otherwise(F.raise_error(F.lit("every question needs a string stem"))).alias("q"),
    )
    return guarded.select("bank_file", "pos", "file_pos", F.from_json("q", schema).alias("q")).select("bank_file", "pos", "file_pos", "q.*")


def read_bank_table(spark: SparkSession, path: str, schema: str = BANK_SCHEMA) -> DataFrame:
    """A bank as Parquet, or as JSON lines if ``path`` ends so; rows carry their own ``pos``."""
    if path.endswith((".jsonl", ".ndjson")):
        return spark.read.schema(f"pos long, {schema}").option("mode", "FAILFAST").json(path)
    return spark.read.parquet(path)


def read_documents(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Files of the given folders or paths, once each: path, size, mtime, content, and text if it is text.

    Only the listing is looked at when reading is set up; contents are read by the tasks.
    """
    if not paths:
        raise ValueError("name at least one file or folder")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(sorted(set(paths)))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1))
    rows = raw.withColumn("suffix", suffix).filter(F.col("suffix").isin(*suffixes)).dropDuplicates(["path"])
    if rows.select("path").isEmpty():
        raise ValueError("no supported document")
    is_text = F.col("suffix").isin(".txt", ".md", ".json")
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return rows.select(
        "path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "suffix", "content",
        F.when(is_text, text).alias("text"),
    )


def write_bundle(questions: DataFrame, files: DataFrame, path: str) -> None:
    """Write a portable bundle into a new folder: questions, and the images they refer to.

    References become ``images/<digest>``. ``files`` has path and content. A missing image fails the
    write before anything is written, and an existing folder is never overwritten.
    """
    hashed = files.select("path", F.sha2("content", 256).alias("sha256"))
    manifest = asset_manifest(questions, hashed)
    lost = [r["ref"] for r in manifest.filter("digest IS NULL").orderBy("ref").limit(5).collect()]
    if lost:
        raise ValueError(f"missing images: {lost}")
    # Equal contents are stored once, under the suffix of their first reference, and all references lead there.
    first = manifest.groupBy("digest").agg(F.min("ref").alias("first"))
    name = F.concat(F.lit("images/"), F.substring("digest", 1, 24), F.lower(F.regexp_extract("first", r"(\.[^./]+)?\z", 1)))
    names = manifest.join(first, "digest").select("ref", name.alias("name"), "digest")
    one = attach_per_key(questions, names.select(F.col("ref").alias("image"), F.col("name").alias("__image")), ["image"])
    listed = questions.select("pos", F.posexplode("images").alias("__i", "ref")).join(names, "ref").groupBy("pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__i", "name"))), lambda x: x["name"]).alias("__images")
    )
    out = one.join(listed, "pos", "left")
    rewritten = out.select(*[
        F.coalesce(F.col("__image"), F.col("image")).alias(c) if c == "image"
        else F.coalesce(F.col("__images"), F.col("images")).alias(c) if c == "images" else F.col(c)
        for c in questions.columns
    ])
    rewritten.write.mode("errorifexists").json(f"{path}/questions")
    used = names.groupBy("digest").agg(F.min("name").alias("name"), F.min("ref").alias("path"))
    files.join(used, "path").select("name", "digest", "content").write.mode("errorifexists").parquet(f"{path}/images")
