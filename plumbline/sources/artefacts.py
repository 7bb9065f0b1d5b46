"""Readers of smaller exports: keyed CSV, nested change lists, session events and issue documents."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.sources.records import read_rows


def read_keyed_csv(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """A CSV file with texts in all columns; a key that comes twice or is missing raises."""
    df = spark.read.options(header="true", multiLine="true", escape='"').csv(path)
    null = df.where(F.exists(F.array(*keys), lambda x: x.isNull())).limit(1)
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if not null.isEmpty() or not twice.isEmpty():
        raise ValueError(f"{keys} are no key of {path}")
    return df


def trace_rows(spark: SparkSession, path: str) -> DataFrame:
    """(source_row, raw, error) of a JSON-lines file; lines that are no object are kept as errors."""
    return read_rows(spark, path, "jsonl")


CHANGES = "array<struct<file_path:string,logging_statement:string,logging_statement_begin_line:long,changes:array<struct<change_type:string,commit_hash:string,commit_time:string,new_content:string,old_content:string,new_content_start_line:long,old_content_start_line:long>>>>"


def flatten_changes(df: DataFrame, repo: str, json_col: str) -> DataFrame:
    """(repo, file, line, change, text, commit, time) of every change in JSON lists of log statements; the new text
    counts before the old one, and that before the statement's."""
    item = df.select(F.col(repo).alias("repo"), F.explode(F.from_json(json_col, CHANGES)).alias("i")).select("repo", "i", F.explode("i.changes").alias("c"))
    text = F.coalesce(F.nullif("c.new_content", F.lit("")), F.nullif("c.old_content", F.lit("")), F.col("i.logging_statement"), F.lit(""))
    line = F.coalesce("c.new_content_start_line", "c.old_content_start_line", "i.logging_statement_begin_line")
    return item.select("repo", F.col("i.file_path").alias("file"), line.alias("line"), F.col("c.change_type").alias("change"), text.alias("text"), F.col("c.commit_hash").alias("commit"), F.col("c.commit_time").alias("time"))


def session_events(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, sessions) of JSON lines (session, raw): the completed commands and file changes with their ordinals, and
    each session's number of malformed lines."""
    get = lambda p: F.get_json_object("raw", "$." + p)
    good = F.coalesce(F.try_parse_json("raw").isNotNull(), F.lit(False))
    done = (get("type") == "event_msg") & (get("payload.type") == "item_completed") & (get("payload.item.status") == "completed")
    kind = get("payload.item.type")
    events = rows.where(good & done & ((kind == "FileChange") | ((kind == "CommandExecution") & (get("payload.item.exit_code") == "0"))))
    events = events.select("session", F.coalesce(get("ordinal").try_cast("long"), F.lit(0)).alias("ordinal"), kind.alias("type"), F.coalesce(get("payload.item.command"), F.lit("")).alias("command"), F.coalesce(get("payload.item.stdout"), F.lit("")).alias("stdout"))
    return events, rows.groupBy("session").agg(F.count_if(~good).alias("malformed"))


def missing_requirements(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, ordinal, missing) of every pull request that a session makes: what it did not show before: a file
    change, a commit, a push, a clean status before the first change. Counts run along each session once."""
    before = Window.partitionBy("session").orderBy("ordinal").rangeBetween(Window.unboundedPreceding, -1)
    ran = lambda p: (F.col("type") == "CommandExecution") & F.col("command").rlike(p)
    change = F.min(F.when(F.col("type") == "FileChange", F.col("ordinal"))).over(before)
    df = events.withColumns({"_change": change, "_commits": F.count_if(ran(r"\bgit\s+commit\b")).over(before), "_pushes": F.count_if(ran(r"\bgit\s+push\b")).over(before), "_clean": F.min(F.when(ran("git status --porcelain"), F.col("ordinal"))).over(before)})
    made = df.where(ran(r"\bgh\s+pr\s+create\b") & F.col("stdout").rlike(r"https://github\.com/[^/]+/[^/]+/pull/\d+")).join(sessions, "session", "left")
    tags = (("malformed_session_jsonl", F.col("malformed") > 0), ("no_file_change_before_pr", F.col("_change").isNull()), ("no_commit_before_pr", F.col("_commits") == 0), ("no_push_before_pr", F.col("_pushes") == 0), ("no_prechange_clean_status_check", ~F.coalesce(F.col("_clean") < F.coalesce("_change", "ordinal"), F.lit(False))))
    return made.select("session", "ordinal", F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in tags]), lambda x: x.isNotNull()).alias("missing"))


def paragraphs(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, n, start, end, text) of the paragraphs of documents in nested JSON (body, tables, tabs): offsets count UTF-16
    units from the beginning of the document. Broken documents give no rows."""

    def walk(value):
        if isinstance(value, dict):
            if "paragraph" in value:
                yield "".join(e.get("textRun", {}).get("content", "") for e in value["paragraph"].get("elements", []))
            for k, v in value.items():
                if k != "paragraph":
                    yield from walk(v)
        elif isinstance(value, list):
            for v in value:
                yield from walk(v)

    def run(batches):
        for batch in batches:
            out = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                at = 0
                try:
                    found = list(walk(json.loads(t))) if t is not None else []
                except (ValueError, RecursionError, AttributeError):
                    found = []
                for n, text in enumerate(found):
                    size = len(text.encode("utf-16-le")) // 2
                    out.append((i, n, at, at + size, text))
                    at += size
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            own = batch.column(0).take(pa.array(cols[0], pa.int32()))
            yield pa.RecordBatch.from_arrays([own, *[pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)]], names=["id", "n", "start", "end", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(json_col).alias("t")).mapInArrow(run, f"id {kind}, n int, start int, end int, text string")


def selected_reference(texts: Column, pr_url: Column, commit_url: Column) -> Column:
    """One reference of an issue: exactly one of a pull request and a commit, and one that a frozen text names."""
    one = pr_url.isNotNull() != commit_url.isNotNull()
    url = F.coalesce(pr_url, commit_url)
    return F.when(one & F.exists(texts, lambda t: F.contains(t, url)), url)
