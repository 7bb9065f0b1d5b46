"""Records of pull requests out of CSV, JSON, JSON lines or text exports, in one schema, with the rejected rows told."""

from __future__ import annotations

import csv
import hashlib
import io
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.ranking import global_rank
from plumbline.runtime import with_scheme
from plumbline.sources.store import open_input

# fixed values: canonical fields and the dotted paths that they are found under, the first present one counting
FIELDS = {
    "repository": ("repository", "repository.full_name", "repo", "repo_name", "repository_name", "repo_full_name", "full_name", "base.repo.full_name"),
    "pr_number": ("pr_number", "number", "pull_number", "pull_request_number", "pr_id"),
    "pr_url": ("pr_url", "html_url", "pull_request_url", "url"),
    "pr_actor_type": ("pr_actor_type", "provided_label", "agent", "agent_name", "provenance", "actor_type"),
    "agent_name": ("agent_name", "agent"),
    "base_ref": ("base_ref", "base.ref", "pr_metadata_snapshot.base_ref"),
    "base_sha": ("base_sha", "base.sha", "pr_metadata_snapshot.base_sha"),
    "head_sha": ("head_sha", "head.sha", "pr_metadata_snapshot.head_sha"),
    "commit_shas": ("commit_shas", "pr_commits", "commits", "pr_metadata_snapshot.commit_shas"),
    "initial_commit_shas": ("initial_commit_shas",),
    "created_at": ("created_at",),
    "merged_at": ("merged_at",),
    "cohort": ("cohort",),
    "is_synthetic": ("is_synthetic",),
    "fixture_repository_id": ("fixture_repository_id", "fixture_id"),
    "local_repo_path": ("local_repo_path",),
}
COHORTS = ("primary_cohort", "repair_enriched", "calibration_only")
WRAPPERS = ("rows", "data", "records", "pull_requests", "Sources")
RAW = "source_row long, raw string, error string"


def _json_rows(text: str):
    value = json.loads(text) if text.strip() else []
    if isinstance(value, dict):
        inner = next((value[k] for k in WRAPPERS if isinstance(value.get(k), list)), None)
        value = [value] if inner is None else inner
    if not isinstance(value, list):
        raise ValueError("JSON input must hold objects")
    yield from enumerate(value, 1)


def _rows(path: str, kind: str):
    """(row number, value or None): lines one at a time, except that a JSON document is held whole."""
    with open_input(path) as raw:
        text = io.TextIOWrapper(pa.PythonFile(raw, mode="r") if not hasattr(raw, "readable") else raw, encoding="utf-8-sig", newline="")
        if kind == "csv":
            yield from enumerate(csv.DictReader(text), 2)
        elif kind == "json":
            yield from _json_rows(text.read())
        else:
            for number, line in enumerate(text, 1):
                if kind == "txt" and line.strip() and not line.lstrip().startswith("#"):
                    yield number, {"url": line.strip()}
                elif kind == "jsonl" and line.strip():
                    try:
                        yield number, json.loads(line)
                    except ValueError:
                        yield number, None


def read_rows(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """RAW rows of one export: each as JSON text with its number in the file, or with error invalid_row.

    CSV rows count from 2, others from 1; text files give a URL a line, without blank lines and those that begin with
    #; a row wrapped in {"row": ...} is unwrapped. A document cut short raises. The file is read by an executor.
    """
    kind = {"ndjson": "jsonl"}.get(found := kind or path.rsplit(".", 1)[-1].lower(), found)
    if kind not in ("csv", "jsonl", "json", "txt"):
        raise ValueError("supported formats: csv, jsonl, json, txt")

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                held = []
                for number, value in _rows(p, kind):
                    if isinstance(value, dict) and isinstance(value.get("row"), dict):
                        value = value["row"]
                    good = isinstance(value, dict)
                    held.append((number, json.dumps(value, ensure_ascii=False) if good else None, None if good else "invalid_row"))
                    if len(held) == 4096:
                        yield of(held)
                        held = []
                if held:
                    yield of(held)

    def of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["source_row", "raw", "error"])

    return spark.createDataFrame([(with_scheme(spark, path),)], "path string").mapInArrow(run, RAW)


def lookup(raw: Column, path: str) -> Column:
    """The value under a key as it stands, dots and all, or else along its dotted path; empty texts and lists are null."""
    exact = F.get_json_object(raw, f"$['{path}']")
    found = F.coalesce(exact, F.get_json_object(raw, "$." + path)) if "." in path else exact
    return F.when(~found.isin("", "[]"), found)


def sha_list(value: Column) -> Column:
    """The commits of a list, a JSON text or a separated text, each once, in their order; objects give sha or commit_sha."""
    parsed = F.try_variant_get(F.try_parse_json(value), "$", "array<variant>")
    one = lambda v: F.coalesce(F.try_variant_get(v, "$.sha", "string"), F.try_variant_get(v, "$.commit_sha", "string"), F.try_variant_get(v, "$", "string"))
    listed = F.when(parsed.isNotNull(), F.transform(parsed, one)).otherwise(F.split(F.trim(value), r"[;,\s]+"))
    return F.coalesce(F.array_distinct(F.filter(listed, lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def normalise(rows: DataFrame, mapping: dict[str, str | list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of RAW rows: canonical fields, and (source_row, reason) of the rows that are none.

    The number in a URL wins over any other; cohorts that are unknown become primary_cohort; synthetic records lose
    their identity. A record needs a repository with a number, or a local path.
    """
    mapping = mapping or {}
    if unknown := sorted(set(mapping) - set(FIELDS)):
        raise ValueError(f"unknown fields: {unknown}")
    raw = F.col("raw")
    paths = {f: [mapping[f]] if isinstance(mapping.get(f), str) else list(mapping.get(f, own)) for f, own in FIELDS.items()}
    df = rows.where("error IS NULL").select("source_row", "raw", *[F.coalesce(*[lookup(raw, p) for p in ps]).alias(f) for f, ps in paths.items()])
    nested = F.coalesce(F.get_json_object("repository", "$.full_name"), F.col("repository"))
    url = F.regexp_extract("pr_url", r"^https://(?i:github\.com)/([^/]+/[^/]+)/pull/(\d+)/?(?:[?#].*)?$", 1)
    number = F.regexp_extract("pr_url", r"^https://(?i:github\.com)/([^/]+/[^/]+)/pull/(\d+)/?(?:[?#].*)?$", 2)
    df = df.withColumns({"_url_repo": F.nullif(url, F.lit("")), "repository": nested}).withColumn("repository", F.coalesce("repository", "_url_repo"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("repository", r"^https://github\.com/", ""), r"\.git$", ""), "/+$", "")
    n = F.coalesce(F.nullif(number, F.lit("")), F.col("pr_number")).try_cast("long")
    synthetic = F.coalesce(F.lower("is_synthetic") == "true", F.lit(False))
    df = df.withColumns({"repository": F.when(F.col("repository").startswith("https://github.com/"), bare).otherwise(F.col("repository")), "pr_number": F.when(n > 0, n), "is_synthetic": synthetic})
    reason = (
        F.when(F.col("repository").isNotNull() & ~F.col("repository").rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"), "invalid_repository")
        .when(F.col("is_synthetic"), None)
        .when(F.col("repository").isNotNull() & F.col("pr_number").isNotNull(), F.when(F.lower("_url_repo") != F.lower("repository"), "repository_url_mismatch"))
        .when(F.col("local_repo_path").isNull(), "missing_pr_identity")
    )
    df = df.withColumn("reason", reason)
    gaps = rows.where("error IS NOT NULL").select("source_row", F.col("error").alias("reason")).unionByName(df.where("reason IS NOT NULL").select("source_row", "reason"))
    good = df.where("reason IS NULL").drop("reason", "_url_repo")
    cohort = F.when(F.col("is_synthetic"), "calibration_only").when(F.col("cohort").isin(*COHORTS), F.col("cohort")).otherwise("primary_cohort")
    fixture = F.coalesce("fixture_repository_id", F.concat(F.lit("fixture-"), F.substring(F.sha2(F.coalesce("local_repo_path", F.lit("None")), 256), 1, 12)))
    good = good.withColumns({"cohort": cohort, "commit_shas": sha_list(F.col("commit_shas")), "initial_commit_shas": sha_list(F.col("initial_commit_shas"))})
    real = ~F.col("is_synthetic")
    good = good.withColumns({"fixture_repository_id": F.when(real, F.col("fixture_repository_id")).otherwise(fixture), **{c: F.when(real, F.col(c)) for c in ("repository", "pr_number", "pr_url")}})
    whole = F.col("repository").isNotNull() & F.col("pr_number").isNotNull()
    good = good.withColumn("pr_url", F.when(whole, F.concat(F.lit("https://github.com/"), "repository", F.lit("/pull/"), F.col("pr_number").cast("string"))).otherwise(F.col("pr_url")))
    own = F.to_json(F.array(F.coalesce("fixture_repository_id", "local_repo_path", F.lit("")), F.concat_ws(",", F.when(F.size("initial_commit_shas") > 0, F.col("initial_commit_shas")).otherwise(F.col("commit_shas")))))
    return good.withColumn("record_key", F.when(whole, F.concat("repository", F.lit("#"), F.col("pr_number").cast("string"))).otherwise(own)), gaps


def deduplicated(records: DataFrame, limit: int | None = None) -> DataFrame:
    """One row for each record_key: first present value of each field in the order of source rows, lists joined without
    repeats, and the source rows. limit keeps the keys that came first."""
    lists = ("commit_shas", "initial_commit_shas")
    scalars = [c for c in records.columns if c not in (*lists, "record_key", "source_row", "raw")]
    # union of lists in source order: what came first stays first
    joined = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source_row", c))), lambda x: x[c])))
    out = records.groupBy("record_key").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("source_row"))).alias(c) for c in scalars],
        *[joined(c).alias(c) for c in lists],
        F.sort_array(F.collect_list("source_row")).alias("source_rows"),
    )
    if limit is None:
        return out
    if limit < 0:
        raise ValueError("limit must not be negative")
    return global_rank(out.withColumn("first", F.col("source_rows")[0]), [F.col("first")], "nth").where(F.col("nth") < limit).drop("first", "nth")


def file_digest(path: str) -> str:
    digest = hashlib.sha256()
    with open_input(path) as f:
        while data := f.read(1 << 20):
            digest.update(data)
    return digest.hexdigest()


def ingest(spark: SparkSession, path: str, mapping: dict | None = None, kind: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(records, gaps, schema) of one export: schema has the digest of the file, the rows read and the columns seen."""
    rows = read_rows(spark, path, kind)
    records, gaps = normalise(rows, mapping)
    seen = rows.select(F.explode(F.json_object_keys("raw")).alias("c")).distinct()
    schema = {"input_sha256": file_digest(with_scheme(spark, path)), "rows_read": rows.count(), "columns_observed": sorted(r.c for r in seen.collect()), "limit": limit}
    return deduplicated(records, limit), gaps, schema
