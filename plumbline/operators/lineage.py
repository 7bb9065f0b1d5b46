"""Follow-ups of a case: an ordered walk over its later events, closed by an observation window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trace_cases(events: DataFrame, opens: str, mitigates: str, cutoff: str, days: int, case_col: str = "user_id") -> DataFrame:
    """One row per opening event: (case, opened_id, opened_at, follow_ups, first_mitigation, closed_at, censored).

    The window of an opening ends after `days`, at the next opening of the case, or at the cutoff, whichever is first;
    censored says that the cutoff ended it before its days were over. Follow-ups are the case's events within it. An
    opening without a mitigation in its window has null there: not observed, which is not the same as none. Times and
    ids order events; the openings before an event are counted by one window over the case, without a self join.
    """
    order = Window.partitionBy(case_col).orderBy("ts", "event_id")
    is_open = F.col("event_type") == opens
    rows = events.where(F.col("ts").isNotNull()).withColumn("_nth", F.sum(F.when(is_open, 1).otherwise(0)).over(order)).where("_nth > 0")
    opened = F.min(F.when(is_open, F.col("ts"))).over(Window.partitionBy(case_col, "_nth"))
    limit = F.least(opened + F.expr(f"INTERVAL {int(days)} DAYS"), F.lit(cutoff).cast("timestamp_ntz").cast(events.schema["ts"].dataType))
    rows = rows.withColumns({"_opened": opened, "_limit": limit})
    inside = ~is_open & (F.col("ts") <= F.col("_limit"))
    cured = inside & (F.col("event_type") == mitigates)
    out = rows.groupBy(F.col(case_col).alias("case"), "_nth").agg(
        F.min(F.when(is_open, F.col("event_id"))).alias("opened_id"),
        F.min("_opened").alias("opened_at"),
        F.count(F.when(inside, 1)).alias("follow_ups"),
        F.min_by(F.when(cured, F.col("event_id")), F.when(cured, F.struct("ts", "event_id"))).alias("first_mitigation"),
        F.min("_limit").alias("closed_at"),
    )
    censored = F.col("closed_at") < F.col("opened_at") + F.expr(f"INTERVAL {int(days)} DAYS")
    return out.withColumn("censored", censored).drop("_nth")
