import glob
import os

from pyspark.sql import functions as F

from plumbline.operators.lineage import trace_cases
from plumbline.operators.replay import replay, result, run_whole


def test_corrections_replay_what_they_touch(spark, tmp_path):
    path = str(tmp_path / "out")
    events = spark.range(3000).selectExpr(
        "id AS event_id", "pmod(xxhash64(id), 100) AS user_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, CAST(id AS INT) * 7) AS ts", "element_at(array('error', 'view', 'purchase'), CAST(pmod(xxhash64(id, 3), 3) + 1 AS INT)) AS event_type"
    )
    compute = lambda df: trace_cases(df, "error", "purchase", "2024-01-12 00:00:00", 3)
    rows = lambda df: sorted(map(repr, (tuple(r) for r in df.select(sorted(df.columns)).collect())))
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/_bucket=*/*.parquet")}
    run_whole(events, compute, "case", path, 16)
    before = files()
    assert rows(result(spark, path)) == rows(compute(events))
    # three events belong to another user than was thought, and one user has none any more
    user = F.when(F.col("event_id").isin(5, 77), 41).when(F.col("user_id") == 17, 18).otherwise(F.col("user_id")).cast("long")
    fixed = events.withColumn("old", F.col("user_id")).withColumn("user_id", user)
    moved = fixed.where("old <> user_id")
    touched = moved.select(F.col("old").alias("case")).union(moved.select("user_id"))
    n = replay(fixed.drop("old"), touched, compute, "user_id", "case", path, 16)
    assert n == touched.distinct().count()
    assert rows(result(spark, path)) == rows(compute(fixed))
    after = files()
    same = {f for f in before if after.get(f) == before[f]}
    parts = {r[0] for r in touched.select(F.pmod(F.xxhash64(F.col("case").cast("string")), F.lit(16))).distinct().collect()}
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in same} == set(range(16)) - parts and same
    assert replay(fixed.drop("old"), touched.limit(0), compute, "user_id", "case", path, 16) == 0 and files() == after
