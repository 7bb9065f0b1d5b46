"""Late corrections: of a result that is kept by lineages, those that a correction touches are computed anew, and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.runtime import drop_path, materialize, qualified, release

BUCKET = "_bucket"


def _bucket(lineage: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(lineage.cast("string")), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def run_whole(inputs: DataFrame, compute: Callable[[DataFrame], DataFrame], lineage: str, path: str, buckets: int = 64) -> None:
    """Write compute(inputs) to path, in a folder for each of `buckets` parts of the lineages. compute's rows have the
    column lineage, and those of one depend on the inputs of that one alone."""
    _write(compute(inputs).withColumn(BUCKET, _bucket(F.col(lineage), buckets)), qualified(inputs.sparkSession, path))


def replay(inputs: DataFrame, touched: DataFrame, compute: Callable[[DataFrame], DataFrame], source: str, lineage: str, path: str, buckets: int = 64) -> int:
    """Bring the result at path up to what run_whole would write for the corrected inputs; the number of lineages replayed.

    touched has the lineages, in column lineage, whose inputs a correction changed: those that lost rows and those that
    got some. Their inputs alone, by column source, are computed; the folders that hold them are written anew with their
    other lineages as they were, and all other folders keep their files. A lineage that has no inputs any more goes.
    Null lineages are one lineage. Nothing touched: nothing is written. buckets must be that of the first run.
    """
    spark, path = inputs.sparkSession, qualified(inputs.sparkSession, path)
    keys = materialize(touched.select(F.col(lineage).alias("_k"), _bucket(F.col(lineage), buckets).alias("_b")).distinct(), "touched")
    n = keys.count()
    if not n:
        return 0
    same = lambda c: F.col(c).eqNullSafe(F.col("_k"))
    new = compute(inputs.join(keys.select("_k"), same(source), "left_semi")).withColumn(BUCKET, _bucket(F.col(lineage), buckets))
    # names of folders alone, `buckets` at most
    folders = [r._b for r in keys.select("_b").distinct().collect()]
    old = spark.read.parquet(path).where(F.col(BUCKET).isin(folders))
    kept = old.join(keys.select("_k"), same(lineage), "left_anti")
    rows = materialize(kept.unionByName(new.select(*kept.columns)), "replayed")
    _write(rows, path)
    # a folder whose lineages are all gone has no rows to be written over it
    gone = set(folders) - {r[0] for r in rows.select(BUCKET).distinct().collect()}
    for b in gone:
        drop_path(spark, f"{path}/{BUCKET}={b}")
    release(spark, keys, rows)
    return n


def result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(qualified(spark, path)).drop(BUCKET)
