"""Rules of one threshold for each feature, trained without one cluster for every cluster at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import materialize

AT_LEAST, AT_MOST = "ge", "le"


def _stumps(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, direction, threshold): of each key's table of (v, p, n), values with their positive and negative rows, the
    rule of best balanced accuracy. Thresholds lie between neighbouring values and beyond both ends; ties go to
    at-least, then to the threshold nearest to the middle of the values, then to the smallest."""
    order = Window.partitionBy(*keys).orderBy("v")
    all_ = Window.partitionBy(*keys)
    upto = lambda c: F.sum(c).over(order)
    rows = counts.where("p + n > 0").withColumns({
        "pb": upto("p"), "nb": upto("n"), "ps": F.sum("p").over(all_), "ns": F.sum("n").over(all_), "next": F.lead("v").over(order),
        "i": F.row_number().over(order) - 1, "m": F.count("*").over(all_), "lo": F.min("v").over(all_), "hi": F.max("v").over(all_),
    })
    half = lambda c: F.max(F.when(F.col("i") == F.floor(c / 2), F.col("v"))).over(all_)
    rows = rows.withColumn("middle", (half(F.col("m") - 1) + half(F.col("m"))) / 2).where("ps > 0 AND ns > 0")
    span = F.greatest(F.lit(1.0), F.col("hi") - F.col("lo"))
    zero = F.lit(0).cast("long")
    cuts = F.array(F.struct(F.coalesce((F.col("v") + F.col("next")) / 2, F.col("hi") + span).alias("t"), F.col("pb").alias("pb"), F.col("nb").alias("nb")))
    first = F.array(F.struct((F.col("lo") - span).alias("t"), zero.alias("pb"), zero.alias("nb")))
    rows = rows.withColumn("c", F.explode(F.when(F.col("i") == 0, F.concat(first, cuts)).otherwise(cuts)))
    above = ((F.col("ps") - F.col("c.pb")) / F.col("ps") + F.col("c.nb") / F.col("ns")) / 2
    below = (F.col("c.pb") / F.col("ps") + (F.col("ns") - F.col("c.nb")) / F.col("ns")) / 2
    sides = F.array(F.struct((-above).alias("ba"), F.lit(0).alias("d")), F.struct((-below).alias("ba"), F.lit(1).alias("d")))
    rows = rows.withColumn("s", F.explode(sides))
    best = F.min(F.struct("s.ba", "s.d", F.abs(F.col("c.t") - F.col("middle")).alias("far"), F.col("c.t").alias("t")))
    out = rows.groupBy(*keys).agg(best.alias("x"))
    return out.select(*keys, F.when(F.col("x.d") == 0, AT_LEAST).otherwise(AT_MOST).alias("direction"), F.col("x.t").alias("threshold"))


def _holds(value: Column, rule: Column) -> Column:
    return F.when(rule["direction"] == AT_LEAST, value >= rule["threshold"]).otherwise(value <= rule["threshold"])


def leave_one_out(df: DataFrame, cluster: str, label: str, features: list[str], id_col: str = "id") -> DataFrame:
    """(id, cluster, label, score, direction, threshold, predicted) of every row, by the rules of all other clusters.

    For each cluster a rule of one threshold is trained for each feature on the rows outside of it; a row's score is 100
    times the share of rules that hold, and a last rule on the scores of the training rows predicts. Rows are counted
    once by feature, cluster and value; what is trained without a cluster are the counts of all less its own, so that
    all models come from one pass. Clusters with the same rules, as most have, share the scores of all rows, which are
    counted likewise.

    label is 0 or 1. Rows with a null label, cluster or feature take no part. Clusters without which one label is left
    have no rows. Empty table: no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(cluster).alias("g"), F.col(label).cast("int").alias("y"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    rows = materialize(rows.dropna(subset=["g", "y", *[f"f{i}" for i in range(len(features))]]), "rows")
    tall = rows.select("g", "y", F.posexplode(F.array(*[f"f{i}" for i in range(len(features))])).alias("f", "v"))
    own = materialize(tall.groupBy("f", "g", "v").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")), "counts")
    clusters = own.where("f = 0").select(F.col("g").alias("held")).distinct()

    def without(counts: DataFrame, keys: list[str], held: DataFrame) -> DataFrame:
        """counts of (keys, g, v) summed over all clusters, less those of each held-out one; held has held and the keys."""
        whole = counts.groupBy(*keys, "v").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        less = counts.select(*keys, F.col("g").alias("held"), "v", (-F.col("p")).alias("p"), (-F.col("n")).alias("n"))
        each = whole.join(held, keys).select(*keys, "held", "v", "p", "n").unionByName(less.join(held, [*keys, "held"], "left_semi").select(*keys, "held", "v", "p", "n"))
        return each.groupBy(*keys, "held", "v").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))

    of_feature = clusters.withColumn("f", F.explode(F.array(*[F.lit(i) for i in range(len(features))])))
    rules = _stumps(without(own, ["f"], of_feature), ["f", "held"])
    rules = rules.groupBy("held").agg(F.array_sort(F.collect_list(F.struct("f", "direction", "threshold"))).alias("rules"))
    rules = materialize(rules.withColumn("set", F.md5(F.to_json("rules"))), "rules")

    score = F.lit(0.0)
    for i in range(len(features)):
        score = score + _holds(F.col(f"f{i}"), F.col("rules")[i]).cast("int")
    score = 100 * (score / len(features))
    # every row under every set of rules: that is what the last rule is trained on
    sets = rules.groupBy("set").agg(F.first("rules").alias("rules"))
    scored = rows.crossJoin(sets).groupBy("set", "g", score.alias("v")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    last = _stumps(without(materialize(scored, "scores"), ["set"], rules.select("held", "set")), ["set", "held"])
    met = rows.join(rules, F.col("g") == F.col("held")).withColumn("score", score).join(last.select("held", "direction", "threshold"), "held")
    said = _holds(F.col("score"), F.struct("direction", "threshold")).cast("int")
    return met.select(F.col("id").alias(id_col), F.col("g").alias(cluster), F.col("y").alias(label), "score", "direction", "threshold", said.alias("predicted"))
