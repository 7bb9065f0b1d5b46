"""Connected components of an edge table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.runtime import materialize, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every node of the edges with the smallest node of its component: (node, component).

    Each round hooks every node on its smallest neighbour, jumps pointers once or more until the trees are flat, and
    contracts the edges to the roots. Every node with a smaller neighbour goes in a round, so that a chain or a star is
    done in few rounds. Nothing but whether rows are left reaches the driver, and each round is written to the shared
    folder.

    Nulls: an edge with a null end is ignored. Self loops give a node that is its own component. Repeated and reversed
    edges count once. An empty table gives no rows.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    live = materialize(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while True:
        both = live.select("u", "v").unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root"))
        hooks = materialize(hooks, "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = hooks.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.coalesce(F.col("higher") != F.col("root"), F.lit(False)).alias("moved"))
            jumped = materialize(jumped, "jump")
            release(spark, hooks)
            hooks = jumped
            if hooks.where("moved").isEmpty():
                break
        if labels is None:
            labels = materialize(hooks.select("node", "root"), "labels")
        else:
            step = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            old, labels = labels, materialize(labels.join(step, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "labels")
            release(spark, old)
        a = hooks.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = hooks.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        met = live.join(a, "u").join(b, "v").where("ru <> rv")
        rest = materialize(met.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "contracted")
        release(spark, live, hooks)
        live = rest
        if live.isEmpty():
            release(spark, live)
            return labels.select("node", F.col("root").alias("component"))
