import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import lines
from plumbline.operators import matching as M


def test_many_pairs_are_dealt_in_shares(spark, monkeypatch):
    rnd = random.Random(9)
    pairs = sorted({("a", rnd.randrange(20), rnd.randrange(20), rnd.randrange(5)) for _ in range(300)})
    df = spark.createDataFrame(list({p[1:3]: p for p in pairs}.values()), "stratum string, left_id long, right_id long, score long")
    asked, own = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda d, tag: (asked.append(d._jdf.queryExecution().optimizedPlan().toString()) if tag == "asks" else None) or own(d, tag))
    whole = {tuple(r) for r in M.stable_pairs(df, ["score"], ["score"]).collect()}
    assert not any("RepartitionByExpression [left_id" in p for p in asked)
    asked.clear()
    monkeypatch.setattr(M, "SHARE", 30)
    assert {tuple(r) for r in M.stable_pairs(df, ["score"], ["score"]).collect()} == whole
    assert "RepartitionByExpression [left_id" in asked[0]


def loop(pairs, order):
    """One pair after the other."""
    left, right, out = set(), set(), set()
    for p in sorted(pairs, key=order):
        if (p[0], p[1]) not in left and (p[0], p[2]) not in right:
            left.add((p[0], p[1]))
            right.add((p[0], p[2]))
            out.add(p[:3])
    return out


@pytest.mark.parametrize("values", [3, 1000])
def test_stable_pairs_are_those_of_a_loop(spark, values):
    rnd = random.Random(values)
    pairs = {(rnd.choice("ab"), rnd.randrange(60), rnd.randrange(60)): rnd.randrange(values) for _ in range(900)}
    pairs = [(*k, v) for k, v in pairs.items()]
    df = spark.createDataFrame(pairs, "stratum string, left_id long, right_id long, score long")
    got = {tuple(r)[:3] for r in M.stable_pairs(df, ["score"], ["score"]).collect()}
    assert got == loop(pairs, lambda p: (p[0], p[3], p[1], p[2]))
    # left rows one after the other, each with the best that is free
    want, used = set(), set()
    for s, a in sorted({p[:2] for p in pairs}):
        free = [p for p in pairs if p[:2] == (s, a) and (s, p[2]) not in used]
        if free:
            best = min(free, key=lambda p: (p[3], p[2]))
            used.add((s, best[2]))
            want.add(best[:3])
    assert {tuple(r)[:3] for r in M.stable_pairs(df, ["score"], []).collect()} == want


def test_nulls_repeats_and_empty(spark):
    schema = "stratum string, left_id long, right_id long, score long"
    df = spark.createDataFrame([("a", 1, 2, 5), ("a", 1, 2, 5), ("a", 1, 2, 3), ("a", None, 2, 0), ("a", 1, None, 0), (None, 1, 2, 9)], schema)
    assert {tuple(r) for r in M.stable_pairs(df, ["score"], ["score"]).collect()} == {("a", 1, 2, 3), (None, 1, 2, 9)}
    assert M.stable_pairs(df.limit(0), ["score"], ["score"]).count() == 0 and M.maximum_match(df.limit(0)).count() == 0
    assert {tuple(r) for r in M.maximum_match(df).collect()} == {("a", 1, 2), (None, 1, 2)}


def test_second_tier_takes_what_is_left(spark):
    schema = "s string, id long, v double"
    left = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 10.0), ("b", 3, 20.0)], schema)
    right = spark.createDataFrame([("a", 11, 1.0), ("b", 12, 11.0), ("b", 13, 50.0)], schema)
    got = {tuple(r) for r in M.greedy_match(left, right, "s", "v", 5.0, widened=12.0).collect()}
    assert got == {("a", 1, 11, 1.0), ("a", 2, 12, 1.0)}
    assert {r.left_id for r in M.greedy_match(left, right, "s", "v", 5.0).collect()} == {1}


def test_one_stratum_of_many_pairs(spark):
    a = spark.range(20_000).selectExpr("'x' AS s", "id", "CAST(pmod(xxhash64(id), 1000000) AS DOUBLE) AS v")
    b = spark.range(20_000).selectExpr("'x' AS s", "id", "CAST(pmod(xxhash64(id, 7), 1000000) AS DOUBLE) AS v")
    got = M.greedy_match(a, b, "s", "v", 1500.0)
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "Pandas" not in plan
    x, y = ({r.id: r.v for r in df.collect()} for df in (a, b))
    near, ys = [], sorted((v, i) for i, v in y.items())
    from bisect import bisect_left

    for i, v in x.items():
        for w, j in ys[bisect_left(ys, (v - 1500, -1)) :]:
            if w - v > 1500:
                break
            near.append(("x", i, j, abs(v - w)))
    assert len(near) > 1_000_000
    assert {tuple(r)[:3] for r in got.collect()} == loop(near, lambda p: (p[3], p[1], p[2]))


def largest(edges):
    """Augmenting paths, one at a time."""
    owner = {}

    def find(a, seen):
        for x, b in edges:
            if x == a and b not in seen:
                seen.add(b)
                if b not in owner or find(owner[b], seen):
                    owner[b] = a
                    return True
        return False

    return sum(find(a, set()) for a in sorted({a for a, _ in edges}))


def test_maximum_on_random_and_hard_graphs(spark):
    rnd = random.Random(3)
    edges = {(s, rnd.randrange(25), rnd.randrange(25)) for s in "abc" for _ in range({"a": 30, "b": 60, "c": 200}[s])}
    # a chain in which the first choice by ids has to be turned round from one end to the other
    edges |= {("d", i, i) for i in range(12)} | {("d", i, i + 1) for i in range(-1, 11)}
    df = spark.createDataFrame(sorted(edges), "stratum string, left_id long, right_id long")
    got = [tuple(r) for r in M.maximum_match(df).collect()]
    assert set(got) <= edges
    for s in "abcd":
        own = [g for g in got if g[0] == s]
        assert len({g[1] for g in own}) == len({g[2] for g in own}) == len(own) == largest([e[1:] for e in sorted(edges) if e[0] == s])


def test_nearest_rows_against_all_pairs(spark):
    rnd = random.Random(8)
    left = [(rnd.choice("abz"), i, rnd.choice([0.0, 5.0, rnd.gauss(0, 100), 1e6])) for i in range(60)] + [("a", 900, None), (None, 901, 1.0), ("none", 902, 1.0)]
    right = [(rnd.choice("ab"), i, rnd.choice([0.0, 0.0, 5.0, rnd.gauss(0, 100)])) for i in range(200)] + [("z", 500, 3.0), ("z", 501, None)]
    schema = "s string, id long, v double"
    got = {(r.left_id, r.rank): (r.right_id, r.score) for r in M.nearest_rows(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "s", "v", 4).collect()}
    want = {}
    for s, i, x in left:
        near = sorted((abs(x - y), j) for t, j, y in right if t == s and y is not None) if x is not None else []
        want |= {(i, k + 1): (j, d) for k, (d, j) in enumerate(near[:4])}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(v[1] == pytest.approx(want[k][1]) for k, v in got.items())
    assert M.nearest_rows(spark.createDataFrame([], schema), spark.createDataFrame(right, schema), "s", "v", 4).count() == 0


def test_suffixes(spark):
    paths = spark.createDataFrame([(1, "src/a/b.py"), (2, "b.py"), (3, "xb.py"), (4, None), (5, "src/c/b.py")], "id long, path string")
    patterns = spark.createDataFrame([("a/b.py",), ("b.py",), ("b.py",), (None,), ("c/b.py",)], "pattern string").where("pattern IS NULL OR pattern <> 'a/b.py'")
    assert {tuple(r) for r in M.suffix_matches(paths, patterns, "id", "path", "pattern").collect()} == {(1, "b.py"), (2, "b.py")}


def test_log_distances_of_every_pair(spark, monkeypatch):
    kinds = "id long, k int, ext array<string>, size long, files long, t string"
    exts = [[".py"], [".py", ".go"], [], None, [None, ".py"]]
    a = spark.createDataFrame([(i, None if i == 9 else i % 2, exts[i % 5], i * 3, i % 4, f"2024-01-{i + 1:02d}") for i in range(10)], kinds).withColumn("time", F.col("t").cast("timestamp"))
    b = spark.createDataFrame([(i, None if i == 3 else i % 2, exts[i % 5], i * 7, i % 3, f"2024-02-{i + 1:02d}") for i in range(25)], kinds).withColumn("time", F.col("t").cast("timestamp"))
    score = lines.log_distance(*(F.col(f"{s}.{c}") for c in ("ext", "size", "files", "time") for s in "ab"))
    want = {tuple(r) for r in a.alias("a").join(b.alias("b"), F.col("a.k") == F.col("b.k")).select("a.id", "b.id", score).collect()}
    assert len(want) == 5 * 13 + 4 * 11
    got = M.log_distances(a, b, ["k"])
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    # as many tasks as the pairs ask for, and groups of too many are cut
    monkeypatch.setattr(M, "PAIRS", 8)
    got = M.log_distances(a, b, ["k"])
    assert got.rdd.getNumPartitions() == 14 and sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert M.log_distances(a.limit(0), b, ["k"]).count() == 0


def caliper_loop(left, right, days, ratio):
    """Left rows one after the other; (stratum, id, day, size) on both sides."""
    used, out = set(), set()
    for s, i, t, x in sorted(left, key=lambda r: (r[2], r[1])):
        near = [(abs(math.log1p(x) - math.log1p(y)) + abs(t - u) / 365, abs(t - u), (max(x, y) + 1) / (min(x, y) + 1), j) for r, j, u, y in right if r == s and (s, j) not in used]
        near = [n for n in near if n[1] <= days and n[2] <= ratio]
        if near:
            used.add((s, min(near)[3]))
            out.add((s, i, min(near)[3]))
    return out


def timed(spark, rows):
    df = spark.createDataFrame(rows, "s string, id long, day int, size long")
    return df.withColumn("time", F.timestamp_seconds(F.col("day") * 86400))


@pytest.mark.parametrize("block", [1 << 14, 6])
def test_caliper_blocks_are_a_loop_without_listed_pairs(spark, monkeypatch, block):
    rnd = random.Random(4)
    sides = [[(rnd.choice("ab"), i, rnd.randrange(400), rnd.choice([1, 5, 7, 9, 30])) for i in range(300)] for _ in range(2)]
    # each left row would rather have what the one before takes: one displaced row after the other
    sides[0] += [("c", 1000 + i, 2 * i, 9) for i in range(30)]
    sides[1] += [("c", 2000 + i, 2 * i - 1, 9) for i in range(30)]
    written, own = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, tag: written.append(tag) or own(df, tag))
    monkeypatch.setattr(M, "BLOCK", block, raising=False)
    if block < 100:
        monkeypatch.setattr(M, "SHARE", block)
    got = {tuple(r)[:3] for r in M.caliper_match(timed(spark, sides[0]), timed(spark, sides[1]), "s", 7.0, 3.0).collect()}
    assert got == caliper_loop(*sides, 7.0, 3.0)
    assert "pairs" not in written and (block < 100 or len(written) < 12)


def test_caliper_nulls_repeats_and_empty(spark):
    left = timed(spark, [("a", 1, 0, 5), (None, 2, 0, 5), ("a", None, 0, 5), ("a", 3, None, 5), ("a", 4, 0, None)])
    right = timed(spark, [("a", 11, 7, 5), (None, 12, 0, 5), ("a", None, 0, 5), ("a", 13, None, 5)])
    assert [tuple(r) for r in M.caliper_match(left, right, "s", 7.0, 3.0).collect()] == [("a", 1, 11, 7.0, 1.0, 7 / 365)]
    assert M.caliper_match(left.limit(0), right, "s", 7.0, 3.0).count() == M.caliper_match(left, right.limit(0), "s", 7.0, 3.0).count() == 0
    # two rows of one id are one left row, with the pairs of both
    twice = timed(spark, [("a", 1, 0, 5), ("a", 1, 20, 5), ("a", 2, 21, 5)])
    two = timed(spark, [("a", 11, 1, 9), ("a", 12, 20, 5)])
    assert {tuple(r)[1:3] for r in M.caliper_match(twice, two, "s", 7.0, 3.0).collect()} == {(1, 12)}


def near_loop(left, right, caliper):
    pairs = [(s, i, j, abs(x - y)) for s, i, x in left for t, j, y in right if s == t and abs(x - y) <= caliper]
    return loop(pairs, lambda p: (p[3], p[1], p[2]))


@pytest.mark.parametrize("piece", [1 << 17, 40])
def test_greedy_pieces_are_a_loop_without_listed_pairs(spark, monkeypatch, piece):
    rnd = random.Random(6)
    # few values: many rows of one value and many ties; a chain in which each pair waits for the one before
    sides = [[(s, f"{h}{i}", float(rnd.randrange(m))) for s, m in (("a", 30), ("b", 400)) for i in range(150)] for h in "lr"]
    for k in range(40):
        sides[k % 2].append(("c", f"{'lr'[k % 2]}c{k}", 1000.0 - k * (k + 1) / 2))
    written, own = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, tag: written.append(tag) or own(df, tag))
    monkeypatch.setattr(M, "PIECE", piece, raising=False)
    a, b = (spark.createDataFrame(side, "s string, id string, v double") for side in sides)
    got = M.greedy_match(a, b, "s", "v", 39.0)
    assert {tuple(r)[:3] for r in got.collect()} == near_loop(*sides, 39.0)
    assert got.columns == ["stratum", "left_id", "right_id", "score"] and "pairs" not in written
    assert written.count("greedy") == 1 if piece > 1000 else written.count("greedy") > 1


@pytest.mark.parametrize("kind", ["double", "int"])
def test_greedy_on_odd_rows(spark, kind):
    schema = f"s string, id long, v {kind}"
    left, right = [("a", 1, 5), ("a", 2, 5), (None, 3, 5), ("a", None, 5), ("a", 4, None), ("b", 1, 9)], [("a", 11, 5), ("a", 12, 7), (None, 13, 5), ("b", 11, 4)]
    of = lambda rows: spark.createDataFrame([(s, i, float(v) if kind == "double" and v is not None else v) for s, i, v in rows], schema)
    assert {tuple(r) for r in M.greedy_match(of(left), of(right), "s", "v", 5.0).collect()} == {("a", 1, 11, 0), ("a", 2, 12, 2), ("b", 1, 11, 5)}
    # rows of one id are one row with the pairs of all
    assert {tuple(r) for r in M.greedy_match(of([("a", 1, 5), ("a", 1, 8)]), of([("a", 11, 4), ("a", 12, 8)]), "s", "v", 5.0).collect()} == {("a", 1, 12, 0)}
    assert M.greedy_match(of(left).limit(0), of(right), "s", "v", 5.0).count() == M.greedy_match(of(left), of(right).limit(0), "s", "v", 5.0).count() == M.greedy_match(of([]), of([]), "s", "v", 5.0).count() == 0


def test_greedy_where_distances_are_rounded_to_one(spark):
    schema = "s string, id long, v double"
    left = [("a", 2, 1e-17), ("a", 1, 0.0), ("a", 3, float("nan")), ("a", 4, float("inf"))]
    right = [("a", 11, 1.0), ("a", 12, float("nan")), ("a", 13, float("inf"))]
    # both are 1.0 away, so that the smaller id comes first although the other is nearer
    assert {tuple(r) for r in M.greedy_match(spark.createDataFrame(left[:2], schema), spark.createDataFrame(right[:1], schema), "s", "v", 5.0).collect()} == {("a", 1, 11, 1.0)}
    assert {tuple(r)[:3] for r in M.greedy_match(spark.createDataFrame(left[1:], schema), spark.createDataFrame(right, schema), "s", "v", 5.0).collect()} == {("a", 1, 11)}
