import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import query_substrings as Q
from plumbline.llm import substrings as S


def brute(rows, k=20):
    seen, out = set(), set()
    for doc, text in sorted((r[:2] for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            if g in seen:
                gone |= set(range(i, i + k))
            seen.add(g)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.add((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=120, vocabulary=60):
    rnd = random.Random(seed)
    word = lambda: "w%d" % min(int(rnd.expovariate(0.1)), vocabulary)
    passages = [[word() for _ in range(rnd.choice([8, 15, 19, 20, 21, 30, 70, 300]))] for _ in range(10)]
    rows = []
    for d in range(n):
        t = []
        for _ in range(rnd.randint(0, 4)):
            t += rnd.choice(passages) if rnd.random() < 0.5 else [word() for _ in range(rnd.randint(1, 60))]
            if rnd.random() < 0.1:
                t += ["a", "b"] * rnd.randint(5, 30)
            if rnd.random() < 0.1:
                t += ["same"] * rnd.randint(15, 50)
        rows.append((d * 2 + 1, rnd.choice([" ", "\n", "\t  "]).join(t), "x"))
    rows += [(500 + i, rows[i % 7][1], "x") for i in range(30)]
    rows += [(900, None, ""), (901, "", ""), (902, "é" * 10 + " " + "ü " * 45, "")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,first", [(1, 20, None), (2, 20, 5), (3, 7, None), (4, 1, None), (5, 20, 1), (6, 20, 20), (7, 23, 3)])
def test_against_brute_force(spark, seed, k, first):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {tuple(r)[:4] for r in S.remove_repeats(df, k, first).collect()}
    assert got == brute(rows, k)


def test_query_and_kept_text(spark, tmp_path):
    rows = corpus(9, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    df.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in Q.op8_substring_dedup(spark, str(tmp_path)).collect()} == brute(rows)
    for r in S.remove_repeats(df, with_text=True).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_query_matches_oracle(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    rel = con.sql(Q.ORACLES["op8_substring_dedup"])
    got = [tuple(r) for r in Q.op8_substring_dedup(spark, d).select(*rel.columns).collect()]
    assert sorted(rel.fetchall()) == sorted(got) and sum(r[rel.columns.index("n_removed")] for r in got) > 0


def test_odd_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(df).count() == 0
    t = " ".join(f"u{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (None, t), (3, t), (3, t), (4, t)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in S.remove_repeats(df).collect()) == [("3", 0), ("3", 0), ("4", 30), ("None", 0), ("None", 0)]


def test_rows_that_share_an_id(spark):
    own = " ".join(f"own{i}" for i in range(90))
    shared = " ".join(f"sh{i}" for i in range(40))
    rows = [("b", own), ("b", shared), ("b", shared), ("b", "few words"), ("c", "x " + shared), (None, shared), ("a", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in S.remove_repeats(df).collect())
    assert got == [("None", 40, 0), ("a", 0, 0), ("b", 2, 0), ("b", 40, 0), ("b", 40, 0), ("b", 90, 0), ("c", 41, 40)]
    rows = [(1, own + " " + shared), (1, "y " + shared), (2, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_removed) for r in S.remove_repeats(df).collect()]
    assert sorted(got) in ([(1, 41, 0), (1, 130, 40), (2, 40, 40)], [(1, 41, 40), (1, 130, 0), (2, 40, 40)])


def test_strip_repeats_with_clashing_columns(spark):
    shared = " ".join(f"sh{i}" for i in range(25))
    rows = [(1, shared, "p", 3, 0), (2, "a  b " + shared, "q", 4, 0), (None, shared, "r", 5, 0), (3, None, "s", 6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, h int, n_chars int").selectExpr("*", "'x' AS _id", "1 AS `a.b`", "2 AS row", "3 AS id")
    got = sorted((tuple(r) for r in S.strip_repeats(df).collect()), key=repr)
    rest = ("x", 1, 2, 3)
    want = [(1, shared, "p", 3, 0, *rest), (2, "a b", "q", 4, 3, *rest), (None, shared, "r", 5, 0, *rest), (3, None, "s", 6, None, *rest)]
    assert got == sorted(want, key=repr)
    assert S.strip_repeats(df.limit(0)).columns == df.columns and S.strip_repeats(df.limit(0)).count() == 0


def test_levels_end_when_no_candidate_is_left(spark, monkeypatch):
    seen = []
    real = S._run_rows
    monkeypatch.setattr(S, "_run_rows", lambda texts, k, length: seen.append(length) or real(texts, k, length))
    words = [f"u{i}" for i in range(60)]
    S.repeated_spans(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[::-1]))], "doc_id long, text string"), 20, 5)
    assert seen == [5]
    seen.clear()
    rows = [(1, " ".join(words)), (2, " ".join(words[:40] + ["v"] * 30)), (3, " ".join(["z"] + words[10:35] + ["w"] * 9))]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20, 5)
    assert sorted((r.doc_id, r.n_removed) for r in got.collect()) == [(1, 0), (2, 69), (3, 25)] and seen == [5, 10, 20]


@pytest.mark.parametrize("length", [1, 2, 3, 5, 10, 20, 31])
def test_window_hashes(length):
    a = np.random.default_rng(0).integers(0, 2**63, 200).astype(np.uint64)
    base = S.BASES[0]
    want = [sum(int(a[i + j]) * pow(base, length - 1 - j, 2**64) for j in range(length)) % 2**64 for i in range(200 - length + 1)]
    assert S.window_hashes(a, length, base).tolist() == want


def test_word_hashes_follow_split():
    parts = [b" ", b"\n", b"\v", b"\x1c", b"\xc2\x85", b"\0", b"a", b"a\0", b"longer", *(b"x" * n for n in (7, 8, 9, 255, 256, 257, 300))]
    for seed in range(200):
        rnd = random.Random(seed)
        texts = [b"".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(rnd.randint(0, 6))]
        hashes, sizes = S.word_hashes(pa.array([b"not this", *texts], pa.binary()).slice(1))
        words = [w for t in texts for w in t.split()]
        assert sizes.tolist() == [len(t.split()) for t in texts]
        assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))


def test_live_windows_alone_are_hashed(monkeypatch):
    """Of a long text with few live windows only their words are looked at; their runs are those of the whole text."""
    texts = pa.array([b" ".join(b"w%d" % i for i in range(5000)), b"", b" ".join(b"v%d" % i for i in range(300))], pa.binary())
    every = S.runs_of(texts, 20, 10)
    mine = np.isin(np.arange(len(every[0])), [3, 4, 50, len(every[0]) - 1])
    rows = [[{"lo": int(lo), "n": int(n)} for t, lo, n in zip(every[0][mine], every[2][mine], every[3][mine], strict=True) if t == k] for k in range(3)]
    hashed = []
    real = S.window_hashes
    monkeypatch.setattr(S, "window_hashes", lambda a, length, base: hashed.append(len(a)) or real(a, length, base))
    got = S.runs_of(texts, 20, 10, pa.array(rows, pa.list_(pa.struct([("lo", pa.int32()), ("n", pa.int16())]))))
    assert [x[mine].tolist() for x in every[:4]] == [x.tolist() for x in got[:4]]
    assert [x[mine].tolist() for x in every[4]] == [x.tolist() for x in got[4]] and max(hashed) < 200
