import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import resampling as B
from plumbline.operators import selection as S
from plumbline.operators.ranking import group_rank
from plumbline.operators.stumps import leave_one_out


def table(spark, seed=1):
    rnd = random.Random(seed)
    rows = [("a", rnd.choice([1e300, -1e300, 0.0, 1.5, rnd.gauss(0, 1)])) for _ in range(300)]
    rows += [("ties", 7.0)] * 200 + [("ties", 8.0)] * 3 + [("one", 3.0), (None, 1.0), (None, 2.0), ("null", None)]
    rows += [("wide", math.exp(rnd.uniform(-300, 300))) for _ in range(300)]
    return rows, spark.createDataFrame(rows, "g string, v double")


@pytest.mark.parametrize("small,ranges", [(10_000, 256), (4, 3)])
def test_percentiles_and_trimmed_means(spark, monkeypatch, small, ranges):
    monkeypatch.setattr(S, "SMALL", small)
    monkeypatch.setattr(S, "RANGES", ranges)
    rows, df = table(spark)
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    if small < 10:
        # few rounds are enough for the rest; values that are apart by powers of ten take one for each
        by = {g: v for g, v in by.items() if g not in ("wide", "a")}
        df = df.where("g IS NULL OR g NOT IN ('wide', 'a')")
    got = {r.g: r for r in S.percentiles(df, "g", "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95}).collect()}
    assert got.keys() == by.keys()
    for g, v in by.items():
        assert [got[g].p0, got[g].p50, got[g].p95] == pytest.approx(np.percentile(v, [0, 50, 95]).tolist(), rel=1e-12)
    means = {r.g: r.trimmed for r in S.trimmed_means(df, "g", "v", 0.1).collect()}
    for g, v in by.items():
        k = math.floor(len(v) * 0.1)
        kept = sorted(v)[k : len(v) - k]
        assert means[g] == pytest.approx(sum(kept) / len(kept), rel=1e-9, abs=1e285 if g == "a" else 0)
    assert S.percentiles(df.limit(0), "g", "v", {"p": 0.5}).count() == 0


def test_whole_numbers_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL", 20)
    df = spark.range(50_000).selectExpr("id % 2 AS g", "CAST(pmod(xxhash64(id), 100000) AS LONG) AS v")
    values = {0: [], 1: []}
    for r in df.collect():
        values[r.g].append(r.v)
    got = S.percentiles(df, "g", "v", {"q": 0.3})
    plan = got._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower().replace("percentiles", "")
    assert {r.g: r.q for r in got.collect()} == pytest.approx({g: float(np.percentile(v, 30)) for g, v in values.items()})


def test_ranks_within_groups(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(50), i, rnd.choice([None, 1, 2])) for i in range(300)]
    got = group_rank(spark.createDataFrame(rows, "g string, x long, i long, w long"), ["g"], [F.col("x").desc(), F.col("i")], "r", "w", "b").collect()
    for g in ("a", "b", None):
        own, total = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 0
        for k, r in enumerate(own):
            assert next((x.r, x.b) for x in got if x.i == r[2]) == (k, total)
            total += r[3] or 0


def test_bootstrap_does_not_depend_on_partitions(spark):
    rnd = random.Random(4)
    rows = [(rnd.random() < 0.4, float(rnd.randrange(6))) for _ in range(2000)] + [(None, 1.0), (True, None)]
    df = spark.createDataFrame(rows, "side boolean, v double")
    a, b = (B.two_sample_bootstrap(df.repartition(k), "side", "v", (2.0, 1.0)).first() for k in (2, 7))
    assert tuple(a) == pytest.approx(tuple(b), rel=1e-12)
    one, two = ([v for s, v in rows if s is side and v is not None] for side in (True, False))
    assert a.effect == pytest.approx(2 * np.mean(one) - np.mean(two))
    spread = math.sqrt(4 * np.var(one) / len(one) + np.var(two) / len(two))
    assert a.lo == pytest.approx(a.effect - 1.96 * spread, abs=0.35 * spread) and a.hi == pytest.approx(a.effect + 1.96 * spread, abs=0.35 * spread)


def test_bootstrap_deals_values_into_tasks(spark):
    df = spark.range(120, numPartitions=1).select((F.col("id") % 2 == 0).alias("side"), F.col("id").cast("double").alias("v"))
    out = B.two_sample_bootstrap(df, "side", "v", replicates=1000)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # 120 values of 1000 draws each: 8 tasks of 16384 draws
    assert any("RepartitionByExpression" in line and line.rstrip().endswith(", 8") for line in plan.splitlines())
    assert B.two_sample_bootstrap(df.limit(0), "side", "v").first().effect is None


def test_poisson_numbers(spark):
    for n in (0.5, 1.0, 7.0, 31.0, 500.0):
        r = spark.range(20_000).select(B.poisson(F.lit(n), F.col("id")).alias("t")).agg(F.avg("t").alias("m"), F.var_pop("t").alias("v"), F.min("t").alias("lo")).first()
        assert r.m == pytest.approx(n, rel=0.04) and r.v == pytest.approx(n, rel=0.08) and r.lo >= 0


def plain_rule(rows):
    """(direction, threshold) by trying all of them; rows are (value, label)."""
    values = sorted({v for v, _ in rows})
    span = max(1.0, values[-1] - values[0])
    cuts = [values[0] - span, *[(a + b) / 2 for a, b in zip(values, values[1:])], values[-1] + span]
    pos, neg = sum(y for _, y in rows), sum(1 - y for _, y in rows)

    def key(rule):
        d, t = rule
        hit = [(v >= t if d == "ge" else v <= t, y) for v, y in rows]
        ba = (sum(h and y for h, y in hit) / pos + sum(not h and not y for h, y in hit) / neg) / 2
        return -round(ba, 12), d != "ge", abs(t - np.median(values)), t

    return min(((d, t) for d in ("ge", "le") for t in cuts), key=key)


def test_leave_one_out_against_each_model_alone(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice("abcde"), int(rnd.random() < 0.4), float(rnd.randrange(5)), rnd.choice([0.0, 1.0]), rnd.gauss(0, 1)) for i in range(160)]
    rows = [(i, g, y, a + 2 * y, b, c) for i, g, y, a, b, c in rows] + [(900, "z", 1, 1.0, 1.0, 0.0), (901, None, 1, 1.0, 0.0, 0.0), (902, "a", None, 0.0, 0.0, 0.0)]
    got = {r.id: (r.score, r.direction, r.threshold, r.predicted) for r in leave_one_out(spark.createDataFrame(rows, "id long, repo string, y int, a double, b double, c double"), "repo", "y", ["a", "b", "c"]).collect()}
    good = [r for r in rows if r[1] is not None and r[2] is not None]
    assert got.keys() == {r[0] for r in good}
    for held in {r[1] for r in good}:
        known = [r for r in good if r[1] != held]
        rules = [plain_rule([(r[3 + k], r[2]) for r in known]) for k in range(3)]
        score = lambda r: 100 * (sum((r[3 + k] >= t) if d == "ge" else (r[3 + k] <= t) for k, (d, t) in enumerate(rules)) / 3)  # noqa: E731, B023
        d, t = plain_rule([(score(r), r[2]) for r in known])
        for r in good:
            if r[1] == held:
                s = score(r)
                assert got[r[0]] == pytest.approx((s, d, t, int(s >= t if d == "ge" else s <= t)))
    one = spark.createDataFrame([(1, "a", 1, 1.0), (2, "b", 1, 2.0)], "id long, repo string, y int, a double")
    assert leave_one_out(one, "repo", "y", ["a"]).count() == 0
