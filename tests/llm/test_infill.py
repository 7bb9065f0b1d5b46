import hashlib
import random
import re

from pyspark.sql import functions as F

from plumbline.llm import infill as I

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(i, text, rate=50, spm_rate=80, seed=42):
    """(n, form, prefix, middle, suffix, output) by slices of the units."""
    t = text or ""
    u = UNIT.findall(t)
    d = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(u), "plain", None, None, None, t
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if h4 % 100 < spm_rate:
        return len(u), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def check(spark, rows, **params):
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, form string, id string, t string, d int, marked int")
    got = I.fill_in_middle(df, **params).withColumn("back", I.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    assert sorted(repr(tuple(r)[:-1]) for r in got) == sorted(repr((r[0], *plain(r[0], r[1], **params))) for r in rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(r[1] or "")
    for i in texts:
        assert sorted(texts[i]) == sorted(r.back for r in got if r.doc_id == i)


def test_against_slices(spark):
    rnd = random.Random(3)
    pieces = ["a", "é", "\U0001f600", " ", "  ", "\n", "\t\x0b\x0c\r", "\x01", "\x02", "d", "e", "\x02e", "\x02d", "<P", "<S", "<M", ">", "<", "<P>", "$0", "\\", " ", "\x85", "\x00", "word"]
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30))), 1, "x", "y", "z", 2, 3) for i in range(800)]
    rows += [(1000 + i, "".join(rnd.choice(pieces[:18]) for _ in range(rnd.randint(0, 30))), 1, "x", "y", "z", 2, 3) for i in range(800)]
    check(spark, rows, rate=100)
    check(spark, rows)


def test_nulls_ties_long_and_empty(spark):
    rest = (1, "x", "y", "z", 2, 3)
    long = " ".join(f"w{k % 97}" for k in range(300_000))
    rows = [(None, None, *rest), (None, "a b c d", *rest), (1, None, *rest), (1, "", *rest), (2, "a b", *rest), (2, "a b", *rest), (3, " \n ", *rest), (4, long, *rest), (5, "x" * 2_000_000, *rest)]
    for rate in (0, 50, 100):
        check(spark, rows, rate=rate)
    check(spark, [], rate=50)
    check(spark, rows[:5], rate=100, spm_rate=0)
    check(spark, rows[:5], rate=100, spm_rate=100, seed=7)


def test_query_matches_oracle(spark):
    import duckdb

    from plumbline.llm import query_infill as Q

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    rel = con.sql(Q.ORACLES["op11_fill_in_middle"])
    got = Q.op11_fill_in_middle(spark, d).select(*rel.columns).collect()
    assert sorted(rel.fetchall(), key=repr) == sorted((tuple(r) for r in got), key=repr)
    assert all(hashlib.sha256((t or "").encode()).hexdigest() == {r.doc_id: r.restored_sha256 for r in got}[i] for i, t in con.sql("SELECT doc_id, text FROM documents").fetchall())
