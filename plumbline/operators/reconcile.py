"""Reconciling a scan with its repair: identities merged, conflicts kept, removals told."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(parent: DataFrame, repair: DataFrame, repaired: DataFrame, cell: list[str], identity: list[str], details: list[str]) -> DataFrame:
    """(cell, identity, origin, variants, conflict, removed) of every match of either side.

    repaired holds the cells that were repaired, with a boolean complete. A complete repair replaces its cell's matches:
    what only the parent has there is removed and has no variant. A partial one adds to them. Equal details collapse;
    different details of one identity are all kept, as a conflict. Keys compare null-safe by their place in one grouping.
    """
    keys = cell + identity
    detail = F.to_json(F.struct(*details), {"ignoreNullFields": "false"})
    both = parent.select(*keys, detail.alias("_d"), F.lit("parent").alias("_o")).unionByName(repair.select(*keys, detail.alias("_d"), F.lit("repair").alias("_o")))
    folded = both.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_set("_o")), "+").alias("origin"),
        F.sort_array(F.collect_set("_d")).alias("_all"),
    )
    state = repaired.select(*[F.col(c).alias(f"_{c}") for c in cell], "complete")
    on = None
    for c in cell:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = same if on is None else on & same
    folded = folded.join(state, on, "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    removed = F.col("complete") & (F.col("origin") == "parent")
    variants = F.when(removed, F.array().cast("array<string>")).otherwise(F.col("_all"))
    return folded.select(*keys, "origin", variants.alias("variants"), (F.size(variants) > 1).alias("conflict"), removed.alias("removed"))
