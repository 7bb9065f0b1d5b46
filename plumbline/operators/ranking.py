"""Global positions and running totals without a window over the whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import materialize


def global_rank(df: DataFrame, order: list[Column], out: str = "rank", total: str | None = None, before: str = "before") -> DataFrame:
    """Number the rows from 0 in a total order; with total, also add the running sum of that column before the row.

    Rows are dealt out by ranges of the order and written, so that the ranges are fixed. Each range is numbered by a
    window of its own, and the ranges' counts, one row for each, give the offsets.

    Nulls sort as the order says. Rows that tie in the whole order are numbered in any order. A null in total counts 0.
    """
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    amount = F.coalesce(F.col(total), F.lit(0)) if total else F.lit(0)
    sums = dealt.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(amount).alias("_t"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "_range",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t0"),
    )
    own = Window.partitionBy("_range").orderBy(*order)
    out_df = dealt.join(sums, "_range").withColumn(out, F.row_number().over(own) - 1 + F.col("_n0"))
    if total:
        inner = own.rowsBetween(Window.unboundedPreceding, -1)
        out_df = out_df.withColumn(before, F.coalesce(F.sum(amount).over(inner), F.lit(0)) + F.col("_t0"))
    return out_df.drop("_range", "_n0", "_t0")


def group_rank(df: DataFrame, groups: list[str], order: list[Column], out: str = "rank", total: str | None = None, before: str = "before") -> DataFrame:
    """global_rank within groups: numbers from 0 and running sums begin anew in each group, however large it is.

    The rows of all groups are numbered in one order, from which each group's first number and sum, one row for each, are
    taken off. A null group is one.
    """
    ranked = global_rank(df, [*[F.col(g).asc_nulls_first() for g in groups], *order], out, total, before)
    ranked = materialize(ranked, "ranked")
    first = ranked.groupBy(*[F.col(g).alias(f"_{i}") for i, g in enumerate(groups)]).agg(F.min(out).alias("_n0"), *([F.min_by(before, out).alias("_t0")] if total else []))
    same = F.lit(True)
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_{i}"))
    met = ranked.join(first, same).withColumn(out, F.col(out) - F.col("_n0"))
    if total:
        met = met.withColumn(before, F.col(before) - F.col("_t0"))
    return met.drop("_n0", "_t0", *[f"_{i}" for i in range(len(groups))])


def global_running(df: DataFrame, order: list[Column], value: Column, how: str, out: str) -> DataFrame:
    """Add the running min, max or sum of value, in a total order of all rows, each row included.

    Ranges of the order run by themselves; what the earlier ones give, one row for each, is put in. Nulls in value
    don't count. Rows that tie in the whole order run in any order.
    """
    fold = {"min": F.min, "max": F.max, "sum": F.sum}[how]
    dealt = df.withColumn("_v", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "running")
    each = dealt.groupBy("_range").agg(fold("_v").alias("_f"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("_range", fold("_f").over(earlier).alias("_before"))
    own = fold("_v").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = dealt.join(each, "_range").withColumn("_own", own)
    both = {"min": F.least("_own", "_before"), "max": F.greatest("_own", "_before"), "sum": F.coalesce(F.col("_own"), F.lit(0)) + F.coalesce(F.col("_before"), F.lit(0))}[how]
    return joined.withColumn(out, both).drop("_v", "_range", "_before", "_own")
