"""Exact order statistics of groups of any size: counts in ranges of values narrow each wanted rank to a range of few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import materialize, release

#: Ranges in a round, and rows of a range that are put in order.
RANGES, SMALL = 256, 10_000


def select_ranks(df: DataFrame, wanted: DataFrame, group: str, value: str) -> DataFrame:
    """(group, w, v): of each group's values, in order from 0, the one of each wanted rank (group, w, r).

    In a round the range of values in which a rank lies is cut into RANGES ranges of one width, whose rows are counted
    with partial sums; the one that holds the rank goes on with its own smallest and largest value. Ranks whose range has
    SMALL rows, or one value, take no part in further rounds. At last these few rows are put in order. No task holds
    a group, however large; a round reads the values between the bounds alone.

    Null values don't count; ranks outside of the group's rows have no row. NaN is an error of the caller's: it has no
    place between bounds. A null group is one. Empty table: no rows.
    """
    spark = df.sparkSession
    rows = materialize(df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v")), "values")
    bounds = rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    todo = wanted.select(F.col(group).alias("_g"), "w", F.col("r").cast("long").alias("r"))
    state = todo.join(bounds, F.col("g").eqNullSafe(F.col("_g"))).where("r >= 0 AND r < n").drop("_g")
    state, done = materialize(state, "ranks"), None
    while True:
        ready = (F.col("lo") == F.col("hi")) | (F.col("n") <= SMALL)
        part = state.where(ready)
        done = part if done is None else done.unionByName(part)
        live = state.where(~ready).withColumnRenamed("g", "_g")
        if live.isEmpty():
            break
        met = rows.join(live, F.col("g").eqNullSafe(F.col("_g")) & F.col("v").between(F.col("lo"), F.col("hi")))
        width = F.col("hi").cast("double") - F.col("lo").cast("double")
        nth = F.least(F.floor((F.col("v").cast("double") - F.col("lo").cast("double")) / width * RANGES), F.lit(RANGES - 1))
        each = met.groupBy("g", "w", "r", nth.alias("k")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g", "w", "r").orderBy("k"))
        each = each.withColumn("before", upto - F.col("n")).where((F.col("before") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("n")))
        state = materialize(each.select((F.col("r") - F.col("before")).alias("r"), "w", "g", "lo", "hi", "n"), "ranks")
    one = done.where("lo = hi").select("g", "w", F.col("lo").alias("v"))
    few = rows.join(done.where("lo < hi").withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")) & F.col("v").between(F.col("lo"), F.col("hi")))
    # SMALL rows at most for each rank
    at = F.row_number().over(Window.partitionBy("g", "w", "r").orderBy("v")) - 1
    few = few.withColumn("at", at).where("at = r").select("g", "w", "v")
    out = materialize(one.unionByName(few), "selected")
    release(spark, rows)
    return out.withColumnRenamed("g", group)


def percentiles(df: DataFrame, group: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """(group, one column for each name of fractions): percentiles of a group's values by linear interpolation between the
    two values around (n - 1) times the fraction. Groups without a value have no row."""
    n = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    h = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in fractions.items()}
    both = F.array(*[F.struct(F.lit(f"{name}{k}").alias("w"), f(x).cast("long").alias("r")) for name, x in h.items() for k, f in (("_lo", F.floor), ("_hi", F.ceil))])
    sizes = materialize(n, "sizes")
    found = select_ranks(df, sizes.select(group, F.explode(both).alias("x")).select(group, "x.*"), group, value)
    wide = found.groupBy(F.col(group).alias("_g")).agg(*[F.max(F.when(F.col("w") == f"{name}{k}", F.col("v").cast("double"))).alias(f"{name}{k}") for name in fractions for k in ("_lo", "_hi")])
    met = sizes.join(wide, F.col(group).eqNullSafe(F.col("_g")))
    return met.select(group, *[(F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (h[name] - F.floor(h[name]))).alias(name) for name in fractions])


def trimmed_means(df: DataFrame, group: str, value: str, share: float, out: str = "trimmed") -> DataFrame:
    """(group, out): the mean of a group's values without the floor(share * n) smallest and largest ones.

    The two bounds are selected; what lies between them is summed, and of the values that equal a bound as many as stay.
    """
    own = df.where(F.col(value).isNotNull())
    sizes = materialize(own.groupBy(group).agg(F.count("*").alias("n")).withColumn("k", F.floor(F.col("n") * F.lit(share))), "sizes")
    ends = F.array(F.struct(F.lit("lo").alias("w"), F.col("k").alias("r")), F.struct(F.lit("hi").alias("w"), (F.col("n") - F.col("k") - 1).alias("r")))
    found = select_ranks(own, sizes.select(group, F.explode(ends).alias("x")).select(group, "x.*"), group, value)
    pick = lambda w: F.max(F.when(F.col("w") == w, F.col("v")))
    bounds = found.groupBy(F.col(group).alias("_g")).agg(pick("lo").alias("lo"), pick("hi").alias("hi"))
    bounds = bounds.join(sizes.select(F.col(group).alias("_h"), "n", "k"), F.col("_g").eqNullSafe(F.col("_h"))).drop("_h")
    v = F.col(value)
    met = own.join(bounds, F.col(group).eqNullSafe(F.col("_g")))
    sums = met.groupBy(group, "lo", "hi", "n", "k").agg(
        F.coalesce(F.sum(F.when((v > F.col("lo")) & (v < F.col("hi")), v)), F.lit(0)).alias("inner"),
        F.count_if(v <= F.col("lo")).alias("low"),
        F.count_if(v >= F.col("hi")).alias("high"),
    )
    kept = F.col("inner") + F.col("lo") * (F.col("low") - F.col("k")) + F.col("hi") * (F.col("high") - F.col("k"))
    return sums.select(group, F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("double")).otherwise(kept / (F.col("n") - 2 * F.col("k"))).alias(out))
