"""Exports: redacted and guarded, one set of files for a kind, written beside the old ones and then put in their place."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.identity import FINGERPRINTED, canonical_json, csv_guard, plain_redact, redact_field
from plumbline.runtime import drop_path, qualified
from plumbline.sources.store import move, open_input, open_output

STAGES = "ingest collect mine detect trace assess export".split()


def _replace(spark: SparkSession, written: str, target: str) -> None:
    """Put a written folder in the place of another; readers see the old one or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (written, target))
    system = b.getFileSystem(conf)
    old = jvm.org.apache.hadoop.fs.Path(f"{target}.old-{uuid.uuid4().hex}")
    had = system.exists(b) and system.rename(b, old)
    if not system.rename(a, b):
        raise OSError(f"{target} could not be put in place")
    if had:
        system.delete(old, True)


def redacted(df: DataFrame) -> DataFrame:
    """df with its text columns redacted by their names; columns of arrays, maps and structs of text as JSON are too."""
    own = {}
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "string":
            own[name] = redact_field(name, c)
        elif kind.startswith(("array", "map", "struct")):
            own[name] = redact_field("" if name in FINGERPRINTED else name, F.to_json(c)) if "string" in kind else F.to_json(c)
        else:
            own[name] = c
    return df.select(*[c.alias(n) for n, c in own.items()])


def export_rows(df: DataFrame, folder: str, kind: str, order: list[str], formats: tuple[str, ...] = ("jsonl", "csv"), compressed: bool = False) -> None:
    """Write df as folder/kind.jsonl and folder/kind.csv, redacted, rows by the order within files that follow each
    other. CSV cells that a spreadsheet would run are guarded. What was there is replaced whole."""
    rows = redacted(df).repartitionByRange(*order).sortWithinPartitions(*order)
    packing = {"compression": "gzip"} if compressed else {}
    for form in formats:
        target = f"{folder.rstrip('/')}/{kind}.{form}"
        written = f"{target}.new-{uuid.uuid4().hex}"
        try:
            if form == "csv":
                guarded = [csv_guard(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in rows.dtypes]
                rows.select(*guarded).write.options(header="true", escape='"', **packing).csv(written)
            else:
                rows.write.options(ignoreNullFields="false", **packing).json(written)
            _replace(df.sparkSession, written, target)
        finally:
            drop_path(df.sparkSession, written)


def write_text(uri: str, text: str) -> None:
    """A small text under a name that appears only once it is whole."""
    part = f"{uri}.part-{uuid.uuid4().hex}"
    with open_output(part) as out:
        out.write(text.encode())
    move(part, uri)


def write_manifest(uri: str, value: dict) -> str:
    """The value as redacted canonical JSON; the digest of what was written."""
    text = canonical_json(plain_redact(value)) + "\n"
    write_text(uri, text)
    return hashlib.sha256(text.encode()).hexdigest()


class KindStore:
    """A folder for each kind of records, replaced whole, and the stages that are done."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, qualified(spark, folder.rstrip("/"))

    def replace(self, kind: str, df: DataFrame) -> None:
        written = f"{self.folder}/{kind}.new-{uuid.uuid4().hex}"
        df.write.parquet(written)
        _replace(self.spark, written, f"{self.folder}/{kind}")

    def read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{kind}")

    def finish(self, stage: str, status: str = "complete", **details) -> None:
        write_text(f"{self.folder}/stage-{stage}.json", canonical_json({"stage": stage, "status": status, "details": details}))

    def status(self, stage: str) -> str | None:
        try:
            with open_input(f"{self.folder}/stage-{stage}.json") as f:
                return json.loads(f.read())["status"]
        except FileNotFoundError:
            return None

    def next_stages(self, stages: list[str] = STAGES, resume: bool = True) -> list[str]:
        """The stages that are to run: with resume, from the first that is not complete on, each after all before it."""
        if not resume:
            return list(stages)
        first = next((i for i, s in enumerate(stages) if self.status(s) != "complete"), len(stages))
        return list(stages[first:])


def allowed(df: DataFrame, columns: list[str], leaves: dict[str, str]) -> DataFrame:
    """The allowed columns of df alone; a row whose value is not as its leaf's pattern says raises when it is read."""
    checked = [F.when(F.col(c).isNull() | F.col(c).cast("string").rlike(f"^(?:{leaves[c]})$"), F.col(c)).otherwise(F.raise_error(F.lit(f"{c}: value is not allowed"))).alias(c) if c in leaves else F.col(c) for c in columns]
    return df.select(*checked)
