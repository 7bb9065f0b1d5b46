"""Gaps and islands: maximal runs of consecutive rows with an equal value."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import materialize


def run_length_ranges(df: DataFrame, groups: list[str], order: str, value: str) -> DataFrame:
    """(groups, value, start, end, n): runs in which order goes up by one and value stays the same.

    Rows are dealt out by ranges of groups and order, so that a group of any size is many tasks' work; runs that touch
    a border of their range, two for each range and group at most, are stitched together afterwards. order holds
    integers; a hole ends a run; rows that repeat an order and a value are one place of the run, counted in n. Nulls in
    groups and value are values of their own; a null order takes no part. Other columns are not read. Empty table: no rows.
    """
    keys = [*groups, value]
    dealt = df.where(F.col(order).isNotNull()).select(*keys, F.col(order).cast("long").alias("_at"))
    dealt = materialize(dealt.repartitionByRange(*groups, "_at").withColumn("_range", F.spark_partition_id()), "ranges")
    same = Window.partitionBy("_range", *keys).orderBy("_at")
    inside = dealt.withColumn("_island", F.col("_at") - F.dense_rank().over(same))
    runs = inside.groupBy("_range", *keys, "_island").agg(F.min("_at").alias("start"), F.max("_at").alias("end"), F.count("*").alias("n"))
    of_range = Window.partitionBy("_range", *groups)
    runs = runs.withColumns({"_lo": F.min("start").over(of_range), "_hi": F.max("end").over(of_range)})
    runs = materialize(runs.withColumn("_border", (F.col("start") == F.col("_lo")) | (F.col("end") == F.col("_hi"))).drop("_lo", "_hi", "_island"), "runs")
    out = [*keys, "start", "end", "n"]
    by_start = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    border = runs.where("_border").withColumn("_new", F.coalesce((F.col("start") > before + 1).cast("int"), F.lit(1)))
    border = border.withColumn("_run", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = border.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return runs.where("NOT _border").select(*out).unionByName(stitched.select(*out))


def continued(stored: DataFrame, new: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Ranges of run_length_ranges over all rows, from those of the rows before and of the rows behind them.

    In each group the last stored range was open: if the first new one goes on with its value at the next place, the two
    are one. All others stay as they are, so that a run needs the stored ranges' ends alone and no row that was seen
    before. New rows have to lie behind the stored ones of their group. Nulls in groups and value are values.
    """
    names = [*groups, value, "start", "end", "n"]
    of = lambda df, pick, name: df.groupBy(*groups).agg(pick.alias(name))
    last = of(stored, F.max(F.struct("end", "start", value, "n")), "_last")
    first = of(new, F.min(F.struct("start", "end", value, "n")), "_first")
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    same = F.lit(True)
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    met = last.join(first.select(*keys, "_first"), same).drop(*[f"_g{i}" for i in range(len(groups))])
    goes_on = (F.col("_last.end") + 1 == F.col("_first.start")) & F.col("_last")[value].eqNullSafe(F.col("_first")[value])
    met = materialize(met.where(goes_on), "open-ranges")
    joined = met.select(*groups, F.col("_last")[value].alias(value), F.col("_last.start").alias("start"), F.col("_first.end").alias("end"), (F.col("_last.n") + F.col("_first.n")).alias("n"))
    gone = met.select(*keys, F.col("_last.start").alias("_a"), F.col("_first.start").alias("_b"))
    rest = stored.join(gone, same & (F.col("start") == F.col("_a")), "left_anti").select(*names)
    more = new.join(gone, same & (F.col("start") == F.col("_b")), "left_anti").select(*names)
    return rest.unionByName(more).unionByName(joined)
