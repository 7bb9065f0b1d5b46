import random

import pytest
import xxhash

from plumbline.llm import simhash as S


def plain_fp(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fps = [(i, plain_fp(t)) for i, t in rows]
    comp = {i: i for i, _ in fps}
    moved = True
    while moved:
        moved = False
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= 3 and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    moved = True
    return {(i, f"{f:016x}", comp[i]) for i, f in fps}


def test_masks_cover_every_radius():
    rnd = random.Random(1)
    masks = S.covering_masks((1 << 64) - 1, 3)
    assert len(masks) == 15
    for _ in range(3000):
        diff = sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3)))
        assert any(not diff & m for m in masks)
    for level in S.mask_tree(3, 3):
        for _ in range(300):
            diff = sum(1 << b for b in rnd.sample(range(64), 3))
            assert any(not diff & m for _, m in level)
    assert max(64 - m.bit_count() for _, m in S.mask_tree(3, 3)[-1]) <= 12


def test_components_against_brute_force(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 150, 300]))]
        for _ in range(rnd.choice([1, 1, 2, 4])):
            t = list(base)
            if rnd.random() < 0.7:
                t[rnd.randrange(len(t))] = "Changed"
            rows.append((len(rows) * 3 + g % 2, " ".join(t)))
    rows += [(9001, None), (9002, ""), (9003, "  \t\n"), (9004, "A b"), (9005, "a B"), (9006, "é É x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in S.simhash_components(df).collect()}
    assert got == plain_components(rows)


def test_dense_group_is_refined(spark):
    # more fingerprints in one ball than a bucket may hold
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 2))) for _ in range(400)} | {rnd.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(S._signed(x),) for x in fps], "fp long")
    from plumbline.operators.components import connected_components

    got = connected_components(S.near_pairs(df, bucket=16), "a", "b").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(r.node)
    left, want = {S._signed(x) for x in fps}, []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            x = todo.pop()
            seen.add(x)
            near = {y for y in left if ((x ^ y) & (2**64 - 1)).bit_count() <= 3}
            left -= near
            todo += near
        want.append(frozenset(seen))
    assert {frozenset(g) for g in groups.values()} == {w for w in want if len(w) > 1}


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fp string, component string")
    assert S.simhash_components(df).count() == 0
    df = spark.createDataFrame([(5, "a b c", "x"), (5, "a b c", "y"), (None, "q", "z")], "doc_id long, text string, fp string")
    rows = S.simhash_components(df).collect()
    assert len(rows) == 3 and [r.component_id for r in rows if r.doc_id == 5] == [5, 5]


if __name__ == "__main__":
    pytest.main([__file__, "-q"])


def test_hot_buckets_can_be_split(spark):
    """Both sides of the join by bucket are plain shuffles of tables, with no aggregation directly below."""
    d = spark.createDataFrame([(i, f"a b c d {i}") for i in range(40)], "doc_id long, text string")
    fps = S.fingerprints(d).select("fp").distinct()
    seen = []
    real = S.materialize
    S.materialize = lambda df, tag: seen.append((tag, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, tag)
    try:
        S.near_pairs(fps).count()
    finally:
        S.materialize = real
    plan = next(p for tag, p in seen if tag == "buckets0")
    assert "Join" in plan and "Aggregate" not in plan.split("Join", 1)[1].split("Relation")[-1]


def test_keep_one_with_any_names(spark):
    rows = [(2, "same text here now", "x", 1), (1, "same text here now", "y", 2), (None, "same text here now", "z", 3), (3, None, "w", 4), (4, "", "v", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, t int").selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS fingerprint")
    got = S.keep_one(df)
    assert got.columns == df.columns and sorted(map(str, (r.doc_id for r in got.collect()))) == ["1", "3", "None"]
    assert S.keep_one(df.limit(0)).count() == 0
