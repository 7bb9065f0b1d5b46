"""Queries of operators that are more than one statement."""

from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

from pyspark.sql import functions as F

from plumbline.functions.exact import fisher_p
from plumbline.functions.identity import canonical, stable_id
from plumbline.functions.shapes import scan_cells
from plumbline.functions.structured import Budget, scan_structured
from plumbline.operators.components import connected_components
from plumbline.operators.lineage import trace_cases
from plumbline.operators.matching import greedy_match, match_cascade
from plumbline.operators.ranges import run_length_ranges
from plumbline.operators.reconcile import reconcile
from plumbline.operators.resampling import cluster_bootstrap
from plumbline.runtime import table


def jon18_matching_cascade(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey")).withColumn("price", F.floor("p_retailprice"))
    before, after = part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1")
    return match_cascade(before, after, [("statement", ["p_brand", "p_type", "price"]), ("template", ["p_name"]), ("symbol", ["p_type", "p_size"])])


def jon24_greedy_matching(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS nation", "s_suppkey AS id", "s_acctbal AS v")
    b = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS nation", "c_custkey AS id", "c_acctbal AS v")
    return greedy_match(a, b, "nation", "v", 200.0)


def set08_components(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    edges = docs.join(first, "text").where("doc_id <> first").select(F.col("doc_id").alias("src"), F.col("first").alias("dst"))
    return connected_components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("component"))


def txt01_content_scan(spark, sf_dir):
    return scan_cells(table(spark, sf_dir, "documents"), "doc_id", "text", None).select("id", "status", F.size("matches").cast("long").alias("n_matches"))


def txt05_review_ranges(spark, sf_dir):
    cells = scan_cells(table(spark, sf_dir, "documents"), "doc_id", "text", None).withColumn("grp", F.lit("text"))
    return run_length_ranges(cells, ["grp"], "id", "status")


def lin08_follow_up_tracing(spark, sf_dir):
    return trace_cases(table(spark, sf_dir, "events"), "error", "purchase", "2024-03-01 00:00:00", 30)


QUERIES = {f.__name__: f for f in (jon18_matching_cascade, jon24_greedy_matching, set08_components, txt01_content_scan, txt05_review_ranges, lin08_follow_up_tracing)}


def _unique(keys: str, name: str, parity: int) -> str:
    return f"SELECT {keys}, min(p_partkey) AS {name} FROM parts WHERE p_partkey % 2 = {parity} GROUP BY {keys} HAVING count(*) = 1"


def _pass(keys: str) -> str:
    return f"SELECT before_id, after_id FROM ({_unique(keys, 'before_id', 0)}) a JOIN ({_unique(keys, 'after_id', 1)}) b USING ({keys})"


ORACLES = {
    "jon18_matching_cascade": f"""
WITH parts AS (SELECT *, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part),
p1 AS (SELECT *, 'statement' AS method FROM ({_pass("p_brand, p_type, price")})),
p2 AS (SELECT *, 'template' AS method FROM ({_pass("p_name")}) WHERE before_id NOT IN (SELECT before_id FROM p1) AND after_id NOT IN (SELECT after_id FROM p1)),
p12 AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
p3 AS (SELECT *, 'symbol' AS method FROM ({_pass("p_type, p_size")}) WHERE before_id NOT IN (SELECT before_id FROM p12) AND after_id NOT IN (SELECT after_id FROM p12))
SELECT * FROM p12 UNION ALL SELECT * FROM p3""",
    "set08_components": """
SELECT d.doc_id, f.first AS component FROM documents d JOIN (SELECT text, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1) f ON d.text = f.text""",
    "lin08_follow_up_tracing": """
WITH e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM events),
o AS (SELECT user_id, nth, event_id AS opened_id, ts AS opened_at, least(ts + INTERVAL 30 DAYS, TIMESTAMP '2024-03-01 00:00:00') AS closed_at FROM e WHERE event_type = 'error')
SELECT o.user_id AS case, opened_id, opened_at, CAST(count(e.event_id) FILTER (WHERE e.event_type <> 'error' AND e.ts <= closed_at) AS BIGINT) AS follow_ups,
       arg_min(e.event_id, (e.ts, e.event_id)) FILTER (WHERE e.event_type = 'purchase' AND e.ts <= closed_at) AS first_mitigation,
       closed_at, closed_at < opened_at + INTERVAL 30 DAYS AS censored
FROM o JOIN e ON o.user_id = e.user_id AND o.nth = e.nth GROUP BY ALL""",
}


def sta08_cluster_bootstrap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return cluster_bootstrap(rows, "source", "toxic", 500).select(*[F.round(c, 9).alias(c) for c in ("mean", "lo", "hi")])


def sta03_fisher_by_language(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    counts = rows.groupBy("lang").agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))
    return counts.withColumn("p", F.round(fisher_p(*map(F.col, "abcd")), 9))


def txt12_structured_scan(spark, sf_dir):
    cells = table(spark, sf_dir, "events").select("event_id", "props")
    return scan_structured(cells, "event_id", "props", Budget.whole()).select("id", "status", F.size("matches").cast("long").alias("n_matches"))


def txt11_reconcile(spark, sf_dir):
    found = scan_cells(table(spark, sf_dir, "documents"), "doc_id", "text", None).select("id", F.explode("matches").alias("m")).select("id", "m.*")
    again = found.where("id % 3 = 0")
    done = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.lit(True).alias("complete"))
    out = reconcile(found, again, done, ["id"], ["start", "end", "category", "subtype"], ["rule"])
    return out.withColumn("variants", F.array_join("variants", ";"))


def fun01_canonical_props(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", canonical(F.col("props")).alias("canonical"), stable_id(F.col("event_id"), F.col("event_type")).alias("stable_id"))


#: One pair after the other: taken if neither of its rows is.
GREEDY = """
go AS (
  SELECT CAST(0 AS BIGINT) AS nr, CAST([] AS VARCHAR[]) AS used, false AS taken
  UNION ALL
  SELECT p.nr, CASE WHEN list_contains(used, 'l' || left_id) OR list_contains(used, 'r' || right_id) THEN used ELSE used || ['l' || left_id, 'r' || right_id] END,
         NOT (list_contains(used, 'l' || left_id) OR list_contains(used, 'r' || right_id))
  FROM go JOIN p ON p.nr = go.nr + 1)"""
ORACLES["jon24_greedy_matching"] = f"""
WITH RECURSIVE p AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY abs(s_acctbal - c_acctbal), s_suppkey, c_custkey) AS nr, s_nationkey AS stratum, s_suppkey AS left_id, c_custkey AS right_id, abs(s_acctbal - c_acctbal) AS score
  FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 200),
{GREEDY}
SELECT stratum, left_id, right_id, score FROM go JOIN p USING (nr) WHERE taken"""
QUERIES |= {f.__name__: f for f in (sta08_cluster_bootstrap, sta03_fisher_by_language, txt12_structured_scan, txt11_reconcile, fun01_canonical_props)}
#: The borders of the Poisson numbers of mean 1: a number beyond k of them is drawn above the k-th.
BORDERS = list(accumulate(exp(-1) / factorial(k) for k in range(8)))
ORACLES["sta08_cluster_bootstrap"] = f"""
WITH s AS (SELECT source AS c, CAST(sum(toxic) AS DOUBLE) AS s, count(toxic) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY 1),
d AS (SELECT b, s, n, CAST('0x' || substr(md5('42:' || b || ':' || coalesce(c, '')), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM s, range(1, 501) r(b)),
t AS (SELECT b, s, n, {' + '.join(f'CAST(u >= CAST({x!r} AS DOUBLE) AS INT)' for x in BORDERS)} AS t FROM d),
e AS (SELECT b, sum(s * t) / sum(n * t) AS m FROM t GROUP BY b)
SELECT round((SELECT sum(s) / sum(n) FROM s), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS lo, round(quantile_cont(m, 0.975), 9) AS hi FROM e"""
ORACLES["txt12_structured_scan"] = "SELECT event_id AS id, CASE WHEN json_valid(props) THEN 'parsed_with_semantic_gaps' ELSE 'invalid_json' END AS status, CAST(0 AS BIGINT) AS n_matches FROM events"
ORACLES["sta03_fisher_by_language"] = """
WITH t AS (
  SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS a, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b,
         count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS d
  FROM documents JOIN labels USING (doc_id) GROUP BY lang),
x AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM t),
w AS (
  SELECT *, -lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS l,
         -lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) AS own
  FROM x),
m AS (SELECT *, max(l) OVER (PARTITION BY lang) AS top FROM w)
SELECT lang, a, b, c, d, round(least(1.0, coalesce(sum(exp(l - top)) FILTER (WHERE l <= own + 1e-9), 0) / sum(exp(l - top))), 9) AS p
FROM m GROUP BY lang, a, b, c, d"""
ORACLES["fun01_canonical_props"] = """
SELECT event_id, replace(replace(props, ' ', ''), chr(10), '') AS canonical, substring(sha256('["2.0",' || event_id || ',"' || event_type || '"]'), 1, 24) AS stable_id FROM events"""
