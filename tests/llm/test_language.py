import random
import zlib

import numpy as np
import pytest

from plumbline.llm import language as L


def plain_subwords(text):
    """Runs of 2 to LONGEST characters of each word between its borders, as strings."""
    out, t = [], "".join(c if c.isalpha() else " " for c in text.lower())
    for w in t.split():
        w = "\0" + w + "\0"
        out += [w[i : i + n] for n in range(2, L.LONGEST + 1) for i in range(len(w) - n + 1)]
    return out


def bucket(s):
    """The bucket of a run by plain integers."""
    m = 0xFFFFFFFF
    h = ord(s[0]) * 0x9E3779B1 & m
    for n, c in enumerate(s[1:], 2):
        h = ((h ^ (h >> 15)) * 0x85EBCA6B + ord(c) * 0x9E3779B1 + n) & m
    h = (h ^ (h >> 16)) * 0xC2B2AE35 & m
    return (h ^ (h >> 13)) % L.BUCKETS


def test_subwords_against_plain_runs():
    rnd = random.Random(2)
    texts = ["", "a", " ", "42", "ab, cd", "Été!", "\U0001d400\U0001d401 x", "x" * 9, "don't  stop", "\0a\0"]
    texts += ["".join(rnd.choice("abé .1\n日") for _ in range(rnd.randint(0, 40))) for _ in range(80)]
    ids, of = L.subwords([t.lower() for t in texts])
    for k, t in enumerate(texts):
        assert sorted(ids[of == k].tolist()) == sorted(map(bucket, plain_subwords(t)))


def test_values_are_means_and_strips_change_nothing(monkeypatch):
    rnd = np.random.default_rng(1)
    for n in (3, 40):
        model = L.Model([f"l{k:02}" for k in range(n)], rnd.normal(size=(L.BUCKETS, L.DIM)).astype(np.float32), rnd.normal(size=(L.DIM, n)).astype(np.float32))
        texts = ["one two three " * 50, "", "x" * 300 + " y", "ÄÖ ü" * 30, "7"]
        want = [np.mean([model.vectors[bucket(s)] @ model.head for s in plain_subwords(t)], axis=0) if plain_subwords(t) else np.zeros(n) for t in texts]
        for strip in (1 << 18, 64, 5):
            monkeypatch.setattr(L, "STRIP", strip)
            got, counts = model.values(texts)
            assert counts.tolist() == [len(plain_subwords(t)) for t in texts]
            assert got == pytest.approx(np.array(want), abs=1e-4)


WORDS = {"xx": ["lorem", "ipsum", "dolor", "sitam"], "yy": ["gruk", "brak", "zwok", "krzy"], "zz": ["éàé", "oùoù", "çaça", "êtrê"]}


def made(n, seed, langs=tuple(WORDS)):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS[k]) + rnd.choice(["", "a", "k"]) for _ in range(rnd.randint(1, 30))), k) for i in range(n) for k in [rnd.choice(langs)]]


SCHEMA = "doc_id long, text string, lang string, id int, t string, h string, u int, n int, f int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", "h", 2, 3, 4) for r in rows], SCHEMA)


def test_learns_from_other_folds_alone(spark):
    rows = made(600, 5)
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    # languages of the held-out fold are wrong: they must not matter
    df = frame(spark, [(i, t, "wrong" if i in held else k) for i, t, k in rows])
    model = L.fit(df)
    assert model.langs == ["xx", "yy", "zz"]
    got = {r.doc_id: r for r in L.identify(df, model).collect()}
    assert len(got) == 600
    right = [got[i].lang_pred == k for i, _, k in rows if i in held]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= r.score <= 1 for r in got.values())
    again = L.fit(df.repartition(7))
    assert np.array_equal(model.vectors, again.vectors) and model.least == again.least and model.temperature == again.temperature
    assert [r.score for r in L.identify(df, again).orderBy("doc_id").collect()] == [got[i].score for i in sorted(got)]


def test_sample_is_bounded_and_copies_count_once(spark):
    rows = made(400, 6) + [(1000 + i, "copied text of one kind", "xx") for i in range(500)] + [(5000, "q " * 5000, "yy")]
    sample = L.training_sample(frame(spark, rows), "doc_id", "text", "lang", 2, 20, 3000).collect()
    for k in WORDS:
        own = [r for r in sample if r.lang == k]
        assert 0 < len(own) <= 20 and sum(len(r.t) for r in own) <= 1000
    assert len({r.t for r in sample}) == len(sample) and {r.t for r in sample} <= {t for _, t, _ in rows}


def test_rejection_is_calibrated():
    noisy = [(t, sorted(WORDS).index(k)) for _, t, k in made(900, 8)]
    rnd = random.Random(9)
    noisy = [(t, k if rnd.random() > 0.05 else rnd.randrange(3)) for t, k in noisy]
    model = L.train([t for t, _ in noisy[:600]], [k for _, k in noisy[:600]], sorted(WORDS))
    model = L.calibrated(model, [t for t, _ in noisy[600:]], [k for _, k in noisy[600:]])
    assert model.least > 0.34
    x, n = model.values(["lorem gruk oùoù", "ipsum ipsum dolor"])
    p = L.softmax(x / model.temperature).max(axis=1)
    assert p[0] < p[1] and n.tolist() == [39, 45]


def test_nulls_empty_long_and_no_model(spark):
    rows = made(200, 7) + [(900, None, "xx"), (901, "", "xx"), (902, "12 !?", None), (None, "gruk brak", None), (None, "gruk brak", "yy"), (903, "lorem " * 100_000, None), (903, "lorem " * 100_000, None)]
    df = frame(spark, rows)
    got = L.identify(df, L.fit(df)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score, by[i].accepted) == ("und", 0.0, False) for i in (900, 901, 902))
    assert by[903].lang_pred == "xx" and by[None].lang_pred == "yy"
    assert L.identify(df.limit(0), None).count() == 0
    nothing = frame(spark, [(1, "lorem", None), (2, None, "xx")])
    assert L.fit(nothing) is None
    assert {r.lang_pred for r in L.identify(nothing, None).collect()} == {"und"}
    one = frame(spark, [(i, "lorem ipsum", "xx") for i in range(8)])
    assert {(r.lang_pred, r.score) for r in L.identify(one, L.fit(one)).collect()} == {("xx", 1.0)}


def test_query_on_the_held_out_fold(spark):
    import duckdb

    from plumbline.llm import query_language as Q

    d = "/root/testdata/sf0.01"
    told = {i: (t, k) for i, t, k in duckdb.sql(f"SELECT doc_id, text, lang FROM '{d}/documents.parquet'").fetchall()}
    got = Q.op12_language_id(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(told)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, told[r.doc_id][0] or ""))) for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == told[r.doc_id][1] for r in held) >= 0.98 * len(held)
