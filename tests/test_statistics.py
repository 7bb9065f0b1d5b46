import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import ranking, ranges
from plumbline.operators import statistics as S


def test_runs_against_plain_loop(spark):
    rnd = random.Random(3)
    rows, at = [], 0
    for _ in range(700):
        at += rnd.choice([1, 1, 1, 1, 2])
        rows.append((rnd.choice(["g", None]) if at > 600 else "g", at, rnd.choice(["a", "a", "a", "b", None]) if rnd.random() < 0.3 else "a"))
    rows += [rows[5], ("h", None, "a"), ("h", 7, "b")]
    want = {}
    for g in {r[0] for r in rows}:
        for v in {r[2] for r in rows}:
            mine = sorted(r[1] for r in rows if r[0] == g and r[2] == v and r[1] is not None)
            start = prev = None
            for x in mine:
                if prev is None or x > prev + 1:
                    start = x
                    want[g, v, start] = [x, 0]
                want[g, v, start][0] = x
                want[g, v, start][1] += 1
                prev = x
    df = spark.createDataFrame(rows, "g string, at long, v string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r.g, r.v, r.start): [r.end, r.n] for r in ranges.run_length_ranges(df, ["g"], "at", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == want
    assert ranges.run_length_ranges(df.limit(0), ["g"], "at", "v").count() == 0


def test_running_folds(spark):
    xs = [random.Random(i).random() for i in range(200)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")
    for how, f in (("min", min), ("max", max), ("sum", sum)):
        got = {r.i: r.o for r in ranking.global_running(df, [F.col("i")], F.col("x"), how, "o").collect()}
        assert all(got[i] == pytest.approx(f(xs[: i + 1])) for i in range(200))


def test_gini_and_adjustments(spark):
    xs = [0.0, 1.0, 5.0, 2.0, 2.0]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    n, s = len(xs), sum(xs)
    assert S.gini(df, "x").first().gini == pytest.approx(sum((2 * (i + 1) - n - 1) * x for i, x in enumerate(sorted(xs))) / (n * s))
    ps = [0.01, 0.04, 0.03, 0.5, 0.2]
    df = spark.createDataFrame([(p,) for p in ps] + [(None,)], "p double")
    o = sorted(ps)
    bh = {p: min(1, min(o[j] * 5 / (j + 1) for j in range(i, 5))) for i, p in enumerate(o)} | {None: None}
    ho = {p: min(1, max(o[j] * (5 - j) for j in range(i + 1))) for i, p in enumerate(o)} | {None: None}
    assert {r.p: r.q for r in S.benjamini_hochberg(df, "p").collect()} == pytest.approx(bh)
    assert {r.p: r.adjusted for r in S.holm(df, "p").collect()} == pytest.approx(ho)


def test_pairs_clusters_and_models(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (1, 0), (0, 1), (0, 0), (None, 1)], "a int, b int")
    r = S.paired_binary(df, "a", "b").first()
    assert (r.n, r.left_only, r.right_only) == (5, 2, 1) and r.effect == pytest.approx(0.2) and r.p == 1 and r.left_low < r.left_rate < r.left_high
    assert S.paired_binary(df.limit(0), "a", "b").first().left_rate is None
    rows = [("x", True, 1.0), ("x", False, 0.0), ("y", True, 3.0), ("y", False, 1.0), ("z", True, 9.0), ("w", True, 0.5), ("w", False, 1.0)]
    e = S.balanced_effect(spark.createDataFrame(rows, "c string, s boolean, v double"), "c", "s", "v")
    assert {r.cluster: r.effect for r in e.collect()} == {"x": 1.0, "y": 2.0, "w": -0.5}
    r = S.sensitivity(e).first()
    assert (r.n, r.same_direction) == (3, True) and r.effect == pytest.approx(2.5 / 3) and (r.low, r.high) == (0.25, 1.5)
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 9.0)], "c string, v double")
    assert {r.cluster: r.effect for r in S.leave_one_out(df, "c", "v").collect()} == {"a": 9.0, "b": 1.5}
    rnd = random.Random(1)
    rows = [(float(rnd.randint(0, 9)), rnd.randint(0, 1)) for _ in range(60)] + [(None, 1), (3.0, None)]
    r = S.stump(spark.createDataFrame(rows, "v double, y int"), "v", "y").first()
    good = [x for x in rows if None not in x]
    pos, neg = sum(y for _, y in good), sum(1 - y for _, y in good)

    def ba(t, up):
        hit = [(v >= t) == up for v, _ in good]
        return (sum(h for h, (_, y) in zip(hit, good, strict=True) if y) / pos + sum(not h for h, (_, y) in zip(hit, good, strict=True) if not y) / neg) / 2

    best = max((round(ba(t, up), 12), -t, up) for t in {v for v, _ in good} for up in (True, False))
    assert (r.threshold, r.above) == (-best[1], best[2]) and r.balanced_accuracy == pytest.approx(best[0])
    assert S.stump(spark.createDataFrame([(1.0, 1)], "v double, y int"), "v", "y").count() == 0
    r = S.classification(spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "p int, y int"), "p", "y").first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 1) and r.precision == pytest.approx(2 / 3) and r.mcc == pytest.approx((2 - 1) / (3 * 3 * 2 * 2) ** 0.5)


def test_turns_and_frames(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("a", 3), ("c", 0)], "g string, v long")
    assert [(r.g, r.v) for r in S.round_robin(df, ["g"], [F.col("v")]).orderBy("turn").collect()] == [("a", 1), ("b", 5), ("c", 0), ("a", 2), ("a", 3)]
    assert {(r.g, r.kept) for r in S.first_groups(df, "g", "v", 2).collect()} == {("a", True), ("b", False), ("c", True)}
    assert sorted(r.batch for r in S.batches(df, [F.col("v")], 2).collect()) == [0, 0, 1, 1, 2]
