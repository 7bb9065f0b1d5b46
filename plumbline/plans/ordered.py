"""Order statistics and ranks of few large groups, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators.matching import nearest_rows
from plumbline.operators.ranking import group_rank
from plumbline.operators.selection import percentiles, trimmed_means
from plumbline.runtime import table


def agg33_trimmed_mean(spark, sf_dir):
    return trimmed_means(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", 0.05)


def agg34_percentiles(spark, sf_dir):
    return percentiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"p50": 0.5, "p95": 0.95})


def agg35_quantile_or_zero(spark, sf_dir):
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    own = customer.where("c_acctbal > 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    q = percentiles(own, "n_regionkey", "c_acctbal", {"q": 0.9})
    return region.join(q, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_name", F.coalesce("q", F.lit(0.0)).alias("q"))


def win11_rank_and_share(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    ranked = group_rank(n, ["l_returnflag"], [F.col("n").desc(), F.col("l_suppkey")], "nth", "n", "before")
    # rows of one number share the place of the first of them
    first = ranked.groupBy(F.col("l_returnflag").alias("f"), F.col("n").alias("m")).agg((F.min("nth") + 1).cast("int").alias("place"))
    whole = n.groupBy(F.col("l_returnflag").alias("g")).agg(F.sum("n").alias("all"))
    met = ranked.join(first, (F.col("l_returnflag") == F.col("f")) & (F.col("n") == F.col("m"))).join(whole, F.col("l_returnflag") == F.col("g"))
    return met.select("l_returnflag", "l_suppkey", "n", "place", ((F.col("before") + F.col("n")) / F.col("all").cast("double")).alias("cumulative"))


def jon27_ranked_candidates(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS nation", "s_suppkey AS id", "s_acctbal AS v")
    b = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS nation", "c_custkey AS id", "c_acctbal AS v")
    return nearest_rows(a, b, "nation", "v", 5).select(F.col("left_id").alias("s_suppkey"), F.col("right_id").alias("c_custkey"), "rank")


QUERIES = {f.__name__: f for f in (jon27_ranked_candidates, agg33_trimmed_mean, agg34_percentiles, agg35_quantile_or_zero, win11_rank_and_share)}

ORACLES = {
    "jon27_ranked_candidates": """
        SELECT s_suppkey, c_custkey, CAST(r AS INT) AS rank FROM (
          SELECT s.s_suppkey, c.c_custkey, row_number() OVER (PARTITION BY s.s_suppkey ORDER BY abs(s.s_acctbal - c.c_acctbal), c.c_custkey) AS r
          FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey) x WHERE r <= 5""",
    "agg33_trimmed_mean": """
        SELECT o_orderpriority, avg(o_totalprice) AS trimmed FROM (
          SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) x
        WHERE r > floor(n * 0.05) AND r <= n - floor(n * 0.05) GROUP BY 1""",
    "agg34_percentiles": "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1",
    "agg35_quantile_or_zero": "SELECT r_name, coalesce(quantile_cont(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0.9), 0.0) AS q FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1",
    "win11_rank_and_share": """
        SELECT l_returnflag, l_suppkey, n, CAST(rank() OVER (PARTITION BY l_returnflag ORDER BY n DESC) AS INT) AS place,
               sum(n) OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey ROWS UNBOUNDED PRECEDING) * 1.0E0 / sum(n) OVER (PARTITION BY l_returnflag) AS cumulative
        FROM (SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) x""",
}
