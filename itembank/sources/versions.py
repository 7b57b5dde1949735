"""Restorable versions of a bank: immutable Parquet folders and an append-only log."""
from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.operators.clean import clean
from itembank.sources.bank import write_bundle

LOG_SCHEMA = "seq long, id string, created double, label string, count long, digest string, data string"


def content_digest(bank: DataFrame) -> str:
    """Order-free digest of all rows: count, xor and sum of row hashes. Nulls count by their column."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(bank.columns)), {"ignoreNullFields": "false"}))
    r = bank.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}-{r['x'] or 0}-{r['s'] or 0}"


class VersionStore:
    """Versions below one folder. The log's newest entry names the current data.

    A commit writes a new data folder, then creates the next log entry, which fails if another
    writer created it first. Nothing is ever rewritten, so a lost job leaves at most an unused folder.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _append(self, entry: dict) -> None:
        fs, p = self._fs(f"{self.path}/log/{entry['seq']:012d}.json")
        try:
            out = fs.create(p, False)
        except Exception as exc:
            raise RuntimeError("the bank was changed by another writer") from exc
        out.write(bytearray(json.dumps(entry, ensure_ascii=False).encode()))
        out.close()

    def versions(self) -> DataFrame:
        """All versions, newest first."""
        fs, p = self._fs(f"{self.path}/log")
        if not fs.exists(p):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).json(f"{self.path}/log").orderBy(F.col("seq").desc())

    def head(self) -> dict | None:
        rows = self.versions().limit(1).collect()
        return rows[0].asDict() if rows else None

    def read(self, version: str | None = None) -> DataFrame:
        """Rows of the current or a named version."""
        entry = self.head() if version is None else self._entry(version)
        if entry is None:
            raise ValueError("the bank has no version yet")
        return self.spark.read.parquet(f"{self.path}/{entry['data']}")

    def _entry(self, version: str) -> dict:
        rows = self.versions().filter(F.col("id") == version).limit(1).collect()
        if not rows:
            raise ValueError("unknown version")
        return rows[0].asDict()

    def _checked_head(self, expected: str | None) -> dict | None:
        head = self.head()
        if expected is not None and (head is None or head["digest"] != expected):
            raise RuntimeError("the bank changed; load it again before saving")
        return head

    def _log(self, head: dict | None, label: str, count: int, digest: str, data: str) -> dict:
        """Two entries: the state before, then the new state."""
        seq = head["seq"] + 1 if head else 0
        if head:
            self._append({**head, "seq": seq, "id": uuid.uuid4().hex, "created": time.time(), "label": f"before: {label}"})
            seq += 1
        entry = {"seq": seq, "id": uuid.uuid4().hex, "created": time.time(), "label": label, "count": count, "digest": digest, "data": data}
        self._append(entry)
        return entry

    def commit(self, bank: DataFrame, label: str, expected: str | None = None) -> dict:
        """Save a new version; refuse if the current digest is not the expected one."""
        head = self._checked_head(expected)
        data = f"data/{uuid.uuid4().hex}"
        bank.write.mode("errorifexists").parquet(f"{self.path}/{data}")
        stored = self.spark.read.parquet(f"{self.path}/{data}")
        return self._log(head, label, stored.count(), content_digest(stored), data)

    def rollback(self, version: str, expected: str) -> dict:
        """Make an earlier version current again; history keeps everything in between."""
        target = self._entry(version)
        stored = self.spark.read.parquet(f"{self.path}/{target['data']}")
        if content_digest(stored) != target["digest"]:
            raise RuntimeError("the stored version fails its check")
        head = self._checked_head(expected)
        return self._log(head, f"rollback to {version}", target["count"], target["digest"], target["data"])


def apply_clean(store: VersionStore, rules: list[str] | None, expected: str) -> tuple[dict, dict]:
    """Clean the current version if it is still the one previewed: (new version, report)."""
    head = store.head()
    if head is None or head["digest"] != expected:
        raise RuntimeError("the bank changed since the preview")
    cleaned, removed, report = clean(store.read(), rules)
    entry = store.commit(cleaned, "rule-based cleaning", expected)
    removed.write.mode("errorifexists").parquet(f"{store.path}/removed/{entry['id']}")
    return entry, report.first().asDict()


def clean_external(bank: DataFrame, files: DataFrame, rules: list[str] | None, path: str) -> dict:
    """Clean a bank kept elsewhere into a new bundle; the source stays as it is."""
    cleaned, removed, report = clean(bank, rules)
    write_bundle(cleaned, files, path)
    removed.write.mode("errorifexists").parquet(f"{path}/removed")
    return report.first().asDict()
