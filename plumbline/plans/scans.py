"""Queries of scans that go on where they ended, of cells read by pages, of histories, corrections and models, with oracles."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from plumbline.operators import history
from plumbline.operators.lineage import trace_cases
from plumbline.operators.pages import scan_pages
from plumbline.operators.ranges import continued, run_length_ranges
from plumbline.operators.replay import replay, result, run_whole
from plumbline.operators.resampling import two_sample_bootstrap
from plumbline.operators.stumps import leave_one_out
from plumbline.plans.custom import ORACLES as FOLLOWED
from plumbline.runtime import scratch_path, table
from plumbline.streaming.cases import trace_stream
from plumbline.streaming.scan import Budgets, advance_rows, scanned

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def inc01_row_cursor(spark, sf_dir):
    """Three advances over documents: two that a budget ends after a third of the rows, in the middle of a file, and one
    to the end."""
    folder, source = scratch_path(spark, "cursor"), f"{sf_dir}/documents.parquet"
    third = spark.read.parquet(source).count() // 3
    for rows in (third, third, None):
        advance_rows(spark, source, lambda df: df.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n_chars")), folder, Budgets(rows=rows))
    return scanned(spark, folder).groupBy("doc_id").agg(F.count("*").alias("visits"), F.first("digest").alias("digest"), F.first("n_chars").alias("n_chars"))


def txt08_paged_scan(spark, sf_dir):
    """Addresses of all documents, read by pages of 2048 characters, so that most documents are several pages."""
    found = scan_pages(table(spark, sf_dir, "documents"), "doc_id", "text", 2048)
    return found.where("rule IN ('email_shape', 'ipv4_shape')").groupBy(F.col("id").alias("doc_id"), "rule").agg(F.count("*").alias("n"))


def jon22_first_integration(spark, sf_dir):
    """A history out of events: every tenth event is on the chain, the ones between are a branch, which a purchase on the
    chain merges; a branch that is not merged goes on with the next ten."""
    ids = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("n"), "event_type")
    sha = lambda n: n.cast("string")
    n = F.col("n")
    merged = ids.where("n % 10 = 0").select(n.alias("_chain"), (F.col("event_type") == "purchase").alias("_merged"))
    rows = ids.join(merged, F.col("_chain") == F.when(n % 10 == 0, n).otherwise(n - n % 10), "left")
    own = F.when(n % 10 == 0, F.when(F.col("_merged"), F.array(n - 10, n - 1)).otherwise(F.array(n - 10)))
    # the first of a branch comes from the chain, or from the last of the branch before if that was not merged
    own = own.when((n % 10 == 1) & F.col("_merged"), F.array(n - 1)).when(n % 10 == 1, F.array(n - 2, n - 1)).otherwise(F.array(n - 1))
    parents = F.transform(F.filter(own, lambda p: p >= 0), sha)
    commits = rows.select(F.lit("r").alias("repository_id"), sha(n).alias("sha"), parents.alias("parents"))
    chain = ids.where("n % 10 = 0").select(F.lit("r").alias("repository_id"), sha(n).alias("sha"), n.alias("position"))
    found = history.earliest_integration(commits, chain)
    return found.select(F.col("sha").cast("long").alias("event_id"), "position", "integration")


def inc09_late_correction(spark, sf_dir):
    """Follow-ups by user, written; then every 97th event turns out to be another user's, and what this touches is replayed."""
    path, events = scratch_path(spark, "follow-ups"), table(spark, sf_dir, "events")
    compute = lambda df: trace_cases(df, "error", "purchase", "2024-03-01 00:00:00", 30)
    run_whole(events, compute, "case", path)
    user = F.when(F.col("event_id") % 97 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).cast(events.schema["user_id"].dataType)
    moved = events.where("event_id % 97 = 0").select(F.explode(F.array("user_id", F.col("user_id") + 1)).alias("case"))
    replay(events.withColumn("user_id", user), moved, compute, "user_id", "case", path)
    return result(spark, path)


def inc10_case_stream(spark, sf_dir):
    """Follow-ups by a stream over events in four files by time, and over an event behind all windows."""
    folder, events = scratch_path(spark, "stream"), table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    cutoff, kept = datetime.datetime(2024, 3, 1), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    last = F.lit("2030-01-01 00:00:00").cast("timestamp")
    end = spark.range(1).select(F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"), last.alias("ts"), F.lit(-1).cast(events.schema["event_id"].dataType).alias("event_id"), F.lit("end").alias("event_type"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for part in (events.repartitionByRange(4, "ts"), end):
            part.write.mode("append").parquet(f"{folder}/in")
            found = trace_stream(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), "error", "purchase", cutoff, 30, "0 seconds")
            out = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark")
            out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    zone = F.lit(spark.conf.get("spark.sql.session.timeZone"))
    plain = lambda c: F.convert_timezone(zone, F.lit("UTC"), F.col(c).cast("timestamp_ntz")).alias(c)
    return spark.read.parquet(f"{folder}/out").select("case", "opened_id", plain("opened_at"), "follow_ups", "first_mitigation", plain("closed_at"), "censored")


def sta14_two_sample_bootstrap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return two_sample_bootstrap(rows.select((F.col("toxic") == 1).alias("side"), (F.floor(F.col("n_chars") / 100)).alias("v")), "side", "v")


def sta16_leave_one_out(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select(F.col("doc_id").alias("id"), "source", "toxic", F.floor(F.col("n_chars") / 500).alias("size"), "quality", (F.col("doc_id") % 5).alias("fifth"))
    return leave_one_out(rows, "source", "toxic", ["size", "quality", "fifth"])


def inc03_open_ranges(spark, sf_dir):
    """Runs of documents of one language, from those of the first half and of the second."""
    rows = table(spark, sf_dir, "documents").select(F.lit("documents").alias("table_path"), F.col("doc_id").alias("at"), "lang")
    half = rows.agg(F.floor((F.min("at") + F.max("at")) / 2)).first()[0] or 0
    parts = [run_length_ranges(rows.where(holds), ["table_path"], "at", "lang") for holds in (F.col("at") <= half, F.col("at") > half)]
    return continued(*parts, ["table_path"], "lang")


def _stump(counts: str, keys: str) -> str:
    """SQL of the best rule of each key's counts."""
    w = f"PARTITION BY {keys}"
    return f"""(
  SELECT {keys}, CASE d WHEN 0 THEN 'ge' ELSE 'le' END AS direction, t AS threshold FROM (
    SELECT *, unnest([0, 1]) AS d, unnest([((ps - pb) / ps + nb / ns) / 2, (pb / ps + (ns - nb) / ns) / 2]) AS ba FROM (
      SELECT {keys}, ps, ns, middle, unnest(CASE WHEN i = 1 THEN [lo - greatest(1.0, hi - lo), t] ELSE [t] END) AS t, unnest(CASE WHEN i = 1 THEN [0, pb] ELSE [pb] END) AS pb, unnest(CASE WHEN i = 1 THEN [0, nb] ELSE [nb] END) AS nb FROM (
        SELECT *, coalesce((v + nx) / 2, hi + greatest(1.0, hi - lo)) AS t FROM (
          SELECT {keys}, v, sum(p) OVER ({w} ORDER BY v) AS pb, sum(n) OVER ({w} ORDER BY v) AS nb, sum(p) OVER ({w}) AS ps, sum(n) OVER ({w}) AS ns, lead(v) OVER ({w} ORDER BY v) AS nx,
                 row_number() OVER ({w} ORDER BY v) AS i, min(v) OVER ({w}) AS lo, max(v) OVER ({w}) AS hi, median(v) OVER ({w}) AS middle FROM {counts})))
    WHERE ps > 0 AND ns > 0)
  QUALIFY row_number() OVER ({w} ORDER BY -ba, d, abs(t - middle), t) = 1)"""


QUERIES = {f.__name__: f for f in (inc01_row_cursor, inc03_open_ranges, txt08_paged_scan, jon22_first_integration, inc09_late_correction, inc10_case_stream, sta14_two_sample_bootstrap, sta16_leave_one_out)}

ORACLES = {
    "inc03_open_ranges": """
SELECT 'documents' AS table_path, lang, min(nr) AS start, max(nr) AS "end", count(*) AS n
FROM (SELECT doc_id AS nr, lang, doc_id - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS island FROM documents) GROUP BY lang, island""",
    "inc01_row_cursor": "SELECT doc_id, CAST(1 AS BIGINT) AS visits, md5(text) AS digest, CAST(length(text) AS INT) AS n_chars FROM documents",
    # what may not stand beside an address is doubled first, so that neighbours do not share it
    "txt08_paged_scan": r"""
WITH each AS (
  SELECT doc_id, 'email_shape' AS rule, regexp_replace(text, '[^A-Za-z0-9._%+@-]', '  ', 'g') AS t FROM documents WHERE contains(text, '@')
  UNION ALL
  SELECT doc_id, 'ipv4_shape', regexp_replace(text, '[^\p{L}0-9._]', '  ', 'g') FROM documents),
found AS (SELECT doc_id, rule, unnest(CASE rule WHEN 'email_shape' THEN regexp_extract_all(t, '(?i)(?:^|[^A-Z0-9._%+-])([A-Z0-9._%+-]{1,64}@[A-Z0-9.-]{1,253}\.[A-Z]{2,63})(?:[^A-Z0-9.-]|$)', 1)
  ELSE regexp_extract_all(t, '(?:^|[^\p{L}0-9._])((?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]))(?:[^\p{L}0-9._]|$)', 1) END) AS v FROM each)
SELECT doc_id, rule, count(*) AS n FROM found GROUP BY ALL""",
    "jon22_first_integration": """
WITH c AS (SELECT event_id AS p, event_type FROM events WHERE event_id % 10 = 0)
SELECT e.event_id, min(c.p) AS position, CAST(min(c.p) AS VARCHAR) AS integration
FROM events e JOIN c ON c.p = e.event_id OR (e.event_id % 10 <> 0 AND c.event_type = 'purchase' AND c.p > e.event_id)
GROUP BY 1""",
    "inc09_late_correction": FOLLOWED["lin08_follow_up_tracing"].replace("FROM events)", "FROM (SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN user_id + 1 ELSE user_id END AS user_id) FROM events))"),
    "inc10_case_stream": FOLLOWED["lin08_follow_up_tracing"],
    "sta16_leave_one_out": f"""
WITH r AS (SELECT doc_id AS id, source, toxic, [CAST(n_chars // 500 AS DOUBLE), CAST(quality AS DOUBLE), CAST(doc_id % 5 AS DOUBLE)] AS x FROM documents JOIN labels USING (doc_id)),
h AS (SELECT DISTINCT source AS held FROM r),
c AS (SELECT held, f, x[f] AS v, CAST(sum(toxic) AS DOUBLE) AS p, CAST(sum(1 - toxic) AS DOUBLE) AS n FROM r JOIN h ON source <> held, range(1, 4) k(f) GROUP BY ALL),
rules AS {_stump("c", "held, f")},
scored AS (
  SELECT id, source, toxic, held, 100 * (sum(CASE WHEN direction = 'ge' THEN x[f] >= threshold ELSE x[f] <= threshold END) / 3) AS score
  FROM r, rules GROUP BY ALL),
s AS (SELECT held, score AS v, CAST(sum(toxic) AS DOUBLE) AS p, CAST(sum(1 - toxic) AS DOUBLE) AS n FROM scored WHERE source <> held GROUP BY ALL),
final AS {_stump("s", "held")}
SELECT id, source, toxic, score, direction, threshold, CAST(CASE WHEN direction = 'ge' THEN score >= threshold ELSE score <= threshold END AS INT) AS predicted
FROM scored JOIN final USING (held) WHERE source = held""",
}
