"""Statistics over rows in a total order, over clusters and over pairs; no window holds the whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.exact import mcnemar_p
from plumbline.operators.ranking import global_rank, group_rank, global_running

Z = 1.959963984540054


def gini(df: DataFrame, value: str) -> DataFrame:
    """(n, gini): sum((2i - n - 1) x) / (n sum(x)) over the sorted values, null if they add up to nothing. Nulls don't count."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    ranked = global_rank(rows, [F.col("x")], "i")
    s = ranked.agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * (F.col("i") + 1)).alias("w"))
    return s.select("n", F.when(F.col("s") != 0, (2 * F.col("w") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s"))).alias("gini"))


def benjamini_hochberg(df: DataFrame, p: str, out: str = "q") -> DataFrame:
    """df with q, the step-up adjustment: the running minimum of p * n / rank from the largest p on. Null p stay null."""
    return _adjusted(df, p, out, "min", lambda rank, n: F.least(F.col(p) * n / rank, F.lit(1.0)), descending=True)


def holm(df: DataFrame, p: str, out: str = "adjusted") -> DataFrame:
    """df with the step-down adjustment: the running maximum of p * (n - rank + 1) from the smallest p on, 1 at most."""
    return _adjusted(df, p, out, "max", lambda rank, n: F.least(F.col(p) * (n - rank + 1), F.lit(1.0)), descending=False)


def _adjusted(df, p, out, how, formula, descending):
    own = df.where(F.col(p).isNotNull())
    ranked = global_rank(own, [F.col(p)], "_rank")
    ranked = ranked.crossJoin(ranked.agg(F.count("*").alias("_n")))
    rank = F.col("_rank") + 1
    order = F.col("_rank").desc() if descending else F.col("_rank")
    done = global_running(ranked, [order], formula(rank, F.col("_n")), how, out).drop("_rank", "_n")
    # equal p share a rank's worth: the adjustment of the group is that of its furthest row
    return done.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def wilson(k: Column, n: Column, upper: bool, z: float = Z) -> Column:
    """A bound of Wilson's interval for k of n; null for n = 0."""
    share = k / n
    middle, spread = share + z * z / (2 * n), z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    bound = (middle + spread if upper else middle - spread) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound)))


def round_robin(df: DataFrame, groups: list[str], order: list[Column], out: str = "turn") -> DataFrame:
    """df with turn from 0: the first row of each group, then the second of each, groups by name within a layer."""
    ranked = global_rank(group_rank(df, groups, order, "_layer"), [F.col("_layer"), *[F.col(g) for g in groups]], out)
    return ranked.drop("_layer")


def first_groups(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """df with kept: whether the row's group is among the `most` whose first rows come first. Excluded rows stay."""
    first = df.groupBy(group).agg(F.min(order).alias("_first"))
    ranked = global_rank(first, [F.col("_first"), F.col(group)], "_nth").select(F.col(group).alias("_g"), (F.col("_nth") < most).alias("kept"))
    return df.join(ranked, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def batches(df: DataFrame, order: list[Column], size: int, out: str = "batch") -> DataFrame:
    """df in batches of size rows at most, in a total order."""
    return global_rank(df, order, "_nth").withColumn(out, F.floor(F.col("_nth") / size).cast("int")).drop("_nth")


def leave_one_out(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """(cluster, effect, influence): the mean of all other clusters' rows, and how far it is from the mean of all."""
    each = df.where(F.col(value).isNotNull()).groupBy(F.col(cluster).alias("cluster")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n"))
    total = each.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    rest = each.crossJoin(total).withColumn("effect", F.when(F.col("tn") > F.col("n"), (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))))
    return rest.select("cluster", "effect", (F.col("effect") - F.col("ts") / F.col("tn")).alias("influence"))


def paired_binary(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row: rates of both sides with Wilson bounds, discordant counts, the difference and McNemar's p. Pairs with a
    null side don't count."""
    a, b = F.col(left).cast("boolean"), F.col(right).cast("boolean")
    c = df.where(a.isNotNull() & b.isNotNull()).agg(
        F.count("*").alias("n"), F.count_if(a).alias("left_n"), F.count_if(b).alias("right_n"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only")
    )
    rate = lambda x: F.when(F.col("n") > 0, F.col(x) / F.col("n"))
    bounds = {f"{s}_{w}": wilson(F.col(f"{s}_n"), F.col("n"), w == "high") for s in ("left", "right") for w in ("low", "high")}
    return c.withColumns({"left_rate": rate("left_n"), "right_rate": rate("right_n"), **bounds}).withColumns(
        {"effect": F.col("left_rate") - F.col("right_rate"), "p": mcnemar_p(F.col("left_only"), F.col("right_only"))}
    )


def balanced_effect(df: DataFrame, cluster: str, side: str, value: str) -> DataFrame:
    """(cluster, a, b, effect) of the clusters with both sides: their mean values and the difference; side is boolean."""
    s = F.col(side).cast("boolean")
    mean = lambda x: F.avg(F.when(x, F.col(value).cast("double")))
    return df.groupBy(F.col(cluster).alias("cluster")).agg(mean(s).alias("a"), mean(~s).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").withColumn("effect", F.col("a") - F.col("b"))


def sensitivity(effects: DataFrame) -> DataFrame:
    """(n, effect, low, high, same_direction): the mean of the clusters' effects, its range when one is left out, and
    whether all these have one sign."""
    total = effects.agg(F.count("*").alias("n"), F.sum("effect").alias("s"))
    loo = effects.crossJoin(total).withColumn("e", F.when(F.col("n") > 1, (F.col("s") - F.col("effect")) / (F.col("n") - 1)))
    return loo.agg(
        F.max("n").alias("n"), F.max(F.col("s") / F.col("n")).alias("effect"), F.min("e").alias("low"), F.max("e").alias("high"),
        F.coalesce(F.bool_and(F.signum("e") == F.signum("s")), F.lit(False)).alias("same_direction"),
    )


def stump(df: DataFrame, value: str, label: str) -> DataFrame:
    """(threshold, above, balanced_accuracy): the cut of the values that tells the labels apart best; ties go to the
    smaller threshold, then to `above`. A row is called 1 if its value is at least (above) or below the threshold.

    Values fold to one row each before they are put in order. Null values and labels don't count; one label alone: no row.
    """
    y = F.col(label).cast("int")
    each = df.where(F.col(value).isNotNull() & y.isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("q"))
    ran = global_running(each, [F.col("x")], F.col("p"), "sum", "up_p")
    ran = global_running(ran, [F.col("x")], F.col("q"), "sum", "up_q")
    total = each.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq")).where("tp > 0 AND tq > 0")
    at = ran.crossJoin(total)
    below_p, below_q = F.col("up_p") - F.col("p"), F.col("up_q") - F.col("q")
    above = ((F.col("tp") - below_p) / F.col("tp") + below_q / F.col("tq")) / 2
    both = at.select("x", F.explode(F.array(F.struct(F.lit(True).alias("above"), above.alias("ba")), F.struct(F.lit(False).alias("above"), (1 - above).alias("ba")))).alias("s"))
    best = F.min_by(F.struct(F.col("x").alias("threshold"), F.col("s.above").alias("above"), F.col("s.ba").alias("balanced_accuracy")), F.struct(-F.round("s.ba", 12), F.col("x"), ~F.col("s.above")))
    return both.agg(best.alias("b")).where("b IS NOT NULL").select("b.*")


def classification(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: counts, precision, recall, specificity, balanced accuracy, F1, Matthews' correlation and likelihood
    ratios; null where a denominator is 0. Rows with a null on either side don't count."""
    p, y = F.col(predicted).cast("boolean"), F.col(actual).cast("boolean")
    c = df.where(p.isNotNull() & y.isNotNull()).agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn")
    )
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    over = lambda a, b: F.when(b != 0, a / b)
    recall, specificity = over(tp, tp + fn), over(tn, tn + fp)
    return c.withColumns({
        "precision": over(tp, tp + fp), "recall": recall, "specificity": specificity, "balanced_accuracy": (recall + specificity) / 2, "f1": over(2 * tp, 2 * tp + fp + fn),
        "mcc": over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "lr_positive": over(recall, 1 - specificity), "lr_negative": over(1 - recall, specificity),
    })
