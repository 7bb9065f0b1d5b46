import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import topk as T


def brute(rows, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out |= {(i, r + 1, j, -x) for r, (x, j) in enumerate(s)}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    return {tuple(r) for r in T.exact_top_k(df, F.col("vec_id") % 50 == 0, **kw).select("query_id", "rank", "vec_id", "score").collect()}


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    hot = [0.5, -0.25, 0.125]
    rows = [(i, hot if rnd.random() < 0.4 else [rnd.uniform(-1, 1) for _ in range(3)], "x") for i in range(500)]
    rows += [(1000, None, ""), (1050, [1.0, None, 2.0], ""), (1100, [float("nan"), 1.0, 1.0], ""), (None, hot, ""), (1150, [float("inf"), 0.0, 0.0], "")]
    rows += [(1200, [1.0, 2.0], ""), (1201, [2.0, 1.0], ""), (1250, [], "")]
    monkeypatch.setattr(T, "SHARD", 64)
    monkeypatch.setattr(T, "BLOCK", 4)
    monkeypatch.setattr(T, "STRIP", 32)
    monkeypatch.setattr(T, "ROW", 2)
    monkeypatch.setattr(T, "FAN", 2)
    assert run(spark, rows) == brute(rows)


def test_large_numbers_are_exact(spark):
    rows = [(0, [1e6, 1e6 + 1, 3.0], ""), (1, [1e6, 1e6, 1.0], ""), (2, [1e6, 1e6, 1.0 + 1 / 256], ""), (3, [-1e6, 5.0, 1.0], "")]
    got = {r[2]: r[1] for r in run(spark, rows)}
    assert got == {2: 1, 1: 2, 3: 3}


def test_few_and_no_rows(spark):
    assert run(spark, []) == set()
    assert run(spark, [(50, [1.0], "")]) == set()
    assert run(spark, [(50, [1.0], ""), (7, [2.0], ""), (7, [2.0], "")]) == {(50, 1, 7, 131072), (50, 2, 7, 131072)}


def test_query_matches_oracle(spark):
    import duckdb

    from plumbline.llm import query_topk as Q

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    rel = con.sql(Q.ORACLES["op3_exact_top_k"])
    assert sorted(rel.fetchall()) == sorted(tuple(r) for r in Q.op3_exact_top_k(spark, d).select(*rel.columns).collect())


def test_ids_are_whole_numbers(spark):
    df = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "vec_id string, embedding array<double>")
    with pytest.raises(ValueError, match="vec_id"):
        T.exact_top_k(df, F.lit(True))
    small = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id int, embedding array<double>")
    assert {tuple(r) for r in T.exact_top_k(small, F.lit(True)).collect()} == {(1, 1, 2, 2 * 256**2), (2, 1, 1, 2 * 256**2)}
