import random

from plumbline.llm import mixing as M


def level(weights, caps, total):
    clamped = set()
    while True:
        w = sum(x for i, x in enumerate(weights) if i not in clamped)
        if not w:
            return float("inf")
        lv = (total - sum(caps[i] for i in clamped)) / w
        new = {i for i in range(len(weights)) if weights[i] * lv > caps[i]}
        if new == clamped:
            return lv
        clamped = new


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, bucket string")


def check(rows, got, max_epochs=3):
    by = {}
    for i, t, s, *_ in rows:
        by.setdefault(s, []).append(len((t or "").split()))
    order = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in by else [])
    sizes = [sum(by[s]) for s in order]
    w = [(5, 2, 1)[k % 3] for k in range(len(order))]
    lv = level(w, [max_epochs * x for x in sizes], sum(sizes))
    for k, s in enumerate(order):
        mine = [r for r in got if r.source == s]
        target = min(w[k] * lv, max_epochs * sizes[k]) if sizes[k] else 0
        assert len(mine) == len(by[s])
        assert all(abs(r.target - target) < 1e-6 and r.source_size == sizes[k] for r in mine)
        assert sum(r.taken for r in mine) == int(target + 0.5)
        assert all(0 <= r.taken <= max_epochs * r.size for r in mine)


def test_water_filling_against_plain_loop(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join("w" * (1 + k % 3) for k in range(rnd.randint(0, 60))), rnd.choice(["a", "b", "Z", "é", "", None, "c"]), 1, "x") for i in range(600)]
    rows += [(1000 + i, "only few words", "tiny", 1, "x") for i in range(2)] + [(2000, None, "nothing", 1, "x"), (2001, "x " * 5000, "a", 1, "y")]
    df = make(spark, rows)
    got = M.mix(df).collect()
    check(rows, got)
    again = M.mix(df.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert sorted(map(repr, got)) != sorted(map(repr, M.mix(df, seed=1).collect()))


def test_small_and_odd_tables(spark):
    assert M.mix(make(spark, [])).count() == 0
    rows = [(1, "a b c", "s", 0, ""), (1, "a b c", "s", 0, ""), (None, "d", None, 0, "")]
    check(rows, M.mix(make(spark, rows)).collect())
    rows = [(1, None, "s", 0, ""), (2, "", "t", 0, "")]
    assert [r.taken for r in M.mix(make(spark, rows)).collect()] == [0, 0]


def test_repeat_documents(spark):
    rnd = random.Random(6)
    rows = [(rnd.randrange(40) if rnd.random() < 0.5 else None, " ".join(f"w{rnd.randrange(9)}" for _ in range(rnd.randint(0, 6))), rnd.choice("abc"), 7, "p") for _ in range(300)]
    rows += [(1, None, "a", None, "p"), (1, "only one", None, 8, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, size string").selectExpr("*", "1 AS m_id", "2 AS _size", "3 AS taken", "4 AS cut")
    got = M.repeat_documents(df)
    assert got.columns == df.columns and [f.dataType for f in got.schema] == [f.dataType for f in df.schema]
    got = [tuple(r) for r in got.collect()]
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in M.repeat_documents(df.repartition(5)).collect())
    for s in ("a", "b", "c", None):
        taken = sum(r.taken for r in M.mix(df).where(M.F.col("source").eqNullSafe(s)).collect())
        assert sum(len(r[1].split()) for r in got if r[2] == s) == taken
    texts = [r[1] or "" for r in rows]
    assert all(t[1] in texts and t[3] == 7 or t[3] == len(t[1]) and any(x.startswith(t[1]) for x in texts) or t[3] == 8 for t in got)
    assert M.repeat_documents(df.limit(0)).count() == 0


def test_query_matches_oracle(spark):
    import duckdb

    from plumbline.llm import query_mixing as Q

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    rel = con.sql(Q.ORACLES["op7_mix_sources"])
    cols = rel.columns
    want = sorted(rel.fetchall())
    assert want == sorted(tuple(r) for r in Q.op7_mix_sources(spark, d).select(*cols).collect())
