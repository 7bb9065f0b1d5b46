"""Scans of all text cells of a table: cells with candidates, their matches, and ranges of rows to be reviewed.

A cell without a candidate is unclassified and goes into a range for review; it is never counted as safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.identity import keyed_digest, stable_id
from plumbline.functions.shapes import EXAMPLE, EXAMPLE_DOMAIN, scan_cells
from plumbline.functions.taxonomy import catalog
from plumbline.operators.pages import scan_pages
from plumbline.operators.ranges import run_length_ranges
from plumbline.operators.ranking import global_rank


def text_cells(df: DataFrame, table: str, row: str = "row_number", columns: list[str] | None = None) -> DataFrame:
    """(table_path, source_row, column_name, text) of all text columns of df, or of those that are named."""
    names = columns or [c for c, t in df.dtypes if t == "string" and c != row]
    if not names:
        return df.sparkSession.createDataFrame([], "table_path string, source_row long, column_name string, text string")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("text")) for c in names]))
    return df.select(F.lit(table).alias("table_path"), F.col(row).cast("long").alias("source_row"), pairs.alias("x")).select("table_path", "source_row", "x.*")


def scan(cells: DataFrame, key: bytes, most: int | None = 1000) -> dict[str, DataFrame]:
    """The parts of a scan of text_cells: cells, matches, ranges and counts.

    cells are those with a candidate or with more than `most`: id, place, characters, the keyed digest of the text and
    status (scanned_with_semantic_gaps or truncated). matches has a row for each candidate with its cell's id; excluded
    ones are placeholders. ranges are the runs of rows of a column without a candidate, which never cross another cell.
    counts tells cells by status.
    """
    place = ["table_path", "source_row", "column_name"]
    named = cells.withColumn("cell_id", stable_id(F.lit("content-cell"), F.col("table_path"), F.col("source_row"), F.col("column_name")))
    found = scan_cells(named.withColumn("digest", keyed_digest(F.col("text"), key)), "cell_id", "text", most, [*place, "digest"]).withColumnRenamed("id", "cell_id")
    kept = found.where("status IN ('matched', 'truncated')")
    status = F.when(F.col("status") == "truncated", "truncated").otherwise("scanned_with_semantic_gaps")
    match = kept.select("cell_id", F.explode("matches").alias("m")).select("cell_id", "m.*")
    match = match.withColumns({"id": stable_id(*[F.col(c) for c in ("cell_id", "start", "end", "category", "subtype", "rule")]), "excluded": F.col("value_status") == "placeholder_or_example"})
    ranges = run_length_ranges(found.where("status = 'no_candidate'"), ["table_path", "column_name"], "source_row", "status")
    return {
        "cells": kept.select("cell_id", *place, F.col("n_chars").alias("characters"), "digest", status.alias("status")),
        "matches": match,
        "ranges": ranges.drop("status"),
        "counts": found.groupBy("table_path", "column_name", "status").agg(F.count("*").alias("cells"), F.sum("n_chars").alias("characters")),
    }


def review_queue(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """What is to be reviewed: every cell by itself, and every range; start_row and end_row say where."""
    one = cells.select("table_path", "column_name", F.col("source_row").alias("start_row"), F.col("source_row").alias("end_row"), "status", F.lit("cell").alias("record_kind"))
    more = ranges.select("table_path", "column_name", F.col("start").alias("start_row"), F.col("end").alias("end_row"), F.lit("unclassified_text").alias("status"), F.lit("source_row_range").alias("record_kind"))
    return one.unionByName(more).withColumn("row_count", F.col("end_row") - F.col("start_row") + 1)


def type_summary(matches: DataFrame) -> DataFrame:
    """(level, category, subtype, occurrences, cells, statuses): all categories and subtypes of the catalog, with 0 where
    there is none; a cell counts once in its category. statuses maps a candidate's status to its number."""
    spark = matches.sparkSession
    own = matches.where("NOT excluded AND category IS NOT NULL")
    n = own.groupBy("category", "subtype", "candidate_status").agg(F.count("*").alias("n"))
    maps = n.groupBy("category", "subtype").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("candidate_status", "n")))).alias("statuses"))
    sub = own.groupBy("category", "subtype").agg(F.count("*").alias("occurrences"), F.count_distinct("cell_id").alias("cells")).join(maps, ["category", "subtype"])
    whole = own.groupBy("category").agg(F.count("*").alias("occurrences"), F.count_distinct("cell_id").alias("cells"))
    of_all = n.groupBy("category", "candidate_status").agg(F.sum("n").alias("n")).groupBy("category").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("candidate_status", "n")))).alias("statuses"))
    known = spark.createDataFrame([(c, s) for c, s, *_ in catalog()], "category string, subtype string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    empty = F.coalesce("statuses", F.create_map().cast("map<string,bigint>")).alias("statuses")
    a = known.join(sub, ["category", "subtype"], "left").select(F.lit("subtype").alias("level"), "category", "subtype", zero("occurrences"), zero("cells"), empty)
    b = known.select("category").distinct().join(whole.join(of_all, "category"), "category", "left").select(F.lit("category").alias("level"), "category", F.lit(None).cast("string").alias("subtype"), zero("occurrences"), zero("cells"), empty)
    return b.unionByName(a)


def repair(cells: DataFrame, source: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """(matches, repaired) of the truncated cells of a scan, read anew from the source's text_cells, by pages and without
    a limit.

    repaired tells each cell's state: complete, source_changed if the text is another than the digest says, or
    source_missing. A private key that is opened and not closed leaves a gap, and its cell is not complete.
    """
    place = ["table_path", "source_row", "column_name"]
    todo = cells.where("status = 'truncated'").select("cell_id", *place, "digest")
    met = todo.join(source.select(*place, "text", F.lit(True).alias("there")), place, "left").withColumn("now", keyed_digest(F.col("text"), key))
    good = met.where("now = digest")
    opened, closed = (F.regexp_count("text", F.lit(f"-----{w} (?:RSA |EC |DSA |ENCRYPTED |OPENSSH )?PRIVATE KEY-----")) for w in ("BEGIN", "END"))
    state = F.when(F.col("there").isNull(), "source_missing").when(~F.coalesce(F.col("now") == F.col("digest"), F.lit(False)), "source_changed").when(opened > closed, "unclosed_private_key_envelope").otherwise("complete")
    match = scan_pages(good, "cell_id", "text").withColumnRenamed("id", "cell_id")
    return match, met.select("cell_id", state.alias("state"), (state == "complete").alias("complete"))


def within_budget(df: DataFrame, order: list[Column], rows: int, size: str | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(taken, rest): the first rows in the order, up to a number and, with size, up to a sum of it; none is lost."""
    ranked = global_rank(df, order, "_nth", size, "_before")
    keep = F.col("_nth") < rows
    if size and most is not None:
        keep &= F.col("_before") + F.coalesce(size, F.lit(0)) <= most
    out = ranked.withColumn("_keep", keep)
    clean = [c for c in df.columns]
    return out.where("_keep").select(*clean), out.where("NOT _keep").select(*clean)


def schema_quality(value: Column, role: str, kind: str) -> Column:
    """{status, reason} of a value in a field whose role is known: null, empty, invalid with why, placeholder or
    schema_context_candidate. kind is the field's type."""
    tell = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    out = F.when(value.isNull(), tell("null", "arrow_null"))
    text = value.cast("string")
    if kind == "string":
        out = out.when(~text.rlike(r"\S"), tell("empty", "empty_or_whitespace_text"))
    if role == "numeric_account_id":
        if kind in ("double", "float"):
            wrong = F.isnan(value) | (F.abs(value) == float("inf"))
            out = out.when(wrong, tell("invalid", "nonfinite_numeric_id")).when(F.floor(value) != value, tell("invalid", "nonintegral_numeric_id"))
            out = out.when(F.abs(value) >= 2.0**53, tell("invalid", "floating_id_precision_unverifiable"))
        elif kind not in ("bigint", "int", "smallint", "tinyint"):
            return out.otherwise(tell("invalid", "expected_numeric_account_id"))
        return out.when(value <= 0, tell("invalid", "nonpositive_numeric_id")).otherwise(tell("schema_context_candidate", "explicit_numeric_account_field"))
    if kind != "string":
        return out.otherwise(tell("invalid", "expected_text_schema_field"))
    bare = F.regexp_replace(text, "^[\"']+|[\"']+$", "")
    example = bare.rlike("^[xX*]{3,}$") | bare.rlike(EXAMPLE) | bare.rlike(EXAMPLE_DOMAIN)
    out = out.when(text.rlike(r"[\x00-\x1f]"), tell("invalid", "control_characters_in_metadata")).when(text.rlike(r"^\s*[{\[]"), tell("invalid", "structured_metadata_requires_interpretation"))
    out = out.when(example, tell("placeholder_or_example", "example_shaped_metadata_not_validated"))
    if role == "author_email":
        out = out.when(~F.trim(text).rlike(r"(?i)^[A-Z0-9._%+-]{1,64}@[A-Z0-9.-]{1,253}\.[A-Z]{2,63}$"), tell("invalid", "email_field_shape_unresolved"))
    return out.otherwise(tell("schema_context_candidate", f"explicit_{role}_field"))


def account_quality(df: DataFrame, column: str, references: DataFrame | None, coverage: str) -> DataFrame:
    """df with quality {status, reason} of an account's name: a match in the reference logins, or unresolved with what
    the references' coverage leaves open. Names are compared as they stand."""
    own = schema_quality(F.col(column), "account_reference", "string")
    why = {"complete": "account_login_not_found_in_frozen_references", "empty": "account_reference_contains_no_values"}.get(coverage, "account_reference_sources_unavailable_or_incomplete")
    tell = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    known = references.select(F.col("login").alias("_login")).distinct() if references is not None else df.sparkSession.createDataFrame([], "_login string")
    joined = df.join(known, F.col(column) == F.col("_login"), "left")
    told = F.when(own["status"] != "schema_context_candidate", own).when(F.col("_login").isNotNull(), tell("schema_context_candidate", "exact_frozen_account_login_match")).otherwise(tell("unresolved", why))
    return joined.withColumn("quality", told).drop("_login")


def schema_scan(df: DataFrame, table: str, roles: dict[str, str], row: str = "row_number") -> DataFrame:
    """(table_path, column_name, status, reason, start, end, n): runs of rows of each field with a role whose values have
    one quality."""
    kinds, out = dict(df.dtypes), None
    for column, role in roles.items():
        q = schema_quality(F.col(column), role, kinds[column])
        one = df.select(F.lit(table).alias("table_path"), F.lit(column).alias("column_name"), F.col(row).alias("at"), q.alias("q"))
        out = one if out is None else out.unionByName(one)
    return run_length_ranges(out, ["table_path", "column_name"], "at", "q").select("table_path", "column_name", "q.status", "q.reason", "start", "end", "n")
