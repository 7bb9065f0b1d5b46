import random
import zlib

import numpy as np
import pytest

from plumbline.llm import query_toxicity as Q
from plumbline.llm import toxicity as T

BAD = ["nasty", "grubling", "wretch"]


def plain_kernel(s, t, order, decay):
    """By all index tuples of both words."""
    from itertools import combinations

    def spans(w):
        out = {}
        for ix in combinations(range(len(w)), order):
            key = tuple(w[i] for i in ix)
            out[key] = out.get(key, 0) + decay ** (ix[-1] - ix[0] + 1)
        return out

    a, b = spans(s), spans(t)
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_kernel_against_all_subsequences():
    rnd = random.Random(0)
    for _ in range(60):
        s, t = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 9))) for _ in range(2))
        got = T.pair_kernel(T.words_matrix([s], 10), T.words_matrix([t], 10, "\1"), 4, 0.7)[0]
        assert got == pytest.approx(plain_kernel(s, t, 4, 0.7))


def test_filter_loses_nothing():
    rnd = random.Random(1)
    marks = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(4, 9))) for _ in range(6)]
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 20))) for _ in range(200)]
    got = T.Kernel(marks).of(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            own = plain_kernel(w, w, 4, 0.7) * plain_kernel(m, m, 4, 0.7)
            assert got[i, j] == pytest.approx(plain_kernel(w, m, 4, 0.7) / own**0.5 if own else 0, abs=1e-9)


def test_long_words_and_any_characters():
    rnd = random.Random(3)
    marks = ["idiot", "\U0001f4a9\U0001f4a9ab\U0001f600", "wretch"]
    for w in ["i" + "x" * 40 + "dxxxiot", "".join(rnd.choice("idotwrech") for _ in range(60)), "\U0001f4a9" * 3 + "ab\U0001f600" + "q" * 30]:
        got = T.Kernel(marks).of([w])[0]
        letters = T.words_matrix([w], len(w))
        for j, m in enumerate(marks):
            pair = T.pair_kernel(letters, T.words_matrix([m], len(m)))[0]
            own = T.pair_kernel(letters, letters)[0] * plain_kernel(m, m, 4, 0.7)
            whole = pair / own**0.5
            assert got[j] >= whole - 1e-12 and (pair == 0) == (got[j] == 0)
            if m == "idiot" and w.startswith("ix"):
                assert whole > 0
    assert T.pair_kernel(T.words_matrix(["xa" * 20], 40), T.words_matrix(["aaaa"], 4))[0] == pytest.approx(plain_kernel("xa" * 20, "aaaa", 4, 0.7))
    assert T.Kernel(marks).of(["\U0001f4a9\U0001f4a9ab\U0001f600", "idiot", "idi"]) == pytest.approx(np.array([[0, 1, 0], [1, 0, 0], [0, 0, 0]]))
    assert T.Kernel(marks).of(["y" * 100_000 + "idiot"])[0, 0] > 0.3


def sample(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["the", "an", "er", "on", "ti", "sh", "wh", "ble"]) for _ in range(rnd.randint(1, 4)))
    rows = []
    for i in range(n):
        sentences = [[word() for _ in range(rnd.randint(3, 12))] for _ in range(rnd.randint(1, 12))]
        toxic = rnd.random() < 0.3
        if toxic:
            s = rnd.choice(sentences)
            s.insert(rnd.randrange(len(s) + 1), rnd.choice(BAD))
        rows.append((i, ". ".join(" ".join(s) for s in sentences) + ".", int(toxic)))
    return rows


def test_held_out_accuracy_and_gaps():
    train, test = sample(1, 600), sample(2, 400)
    scorer = T.train([t for _, t, _ in train], [y for *_, y in train]).scorer()
    p = scorer.scores([t for _, t, _ in test])
    assert ((p >= 0.5) == np.array([y for *_, y in test])).mean() > 0.98
    clean = test[[y for *_, y in test].index(0)][1]
    for w in ("grubling", "g.r.u.b.l.i.n.g", "g r u b l i n g", "grub-ling", "Grubling!", "x" * 500 + "grubling"):
        assert scorer.scores([clean + " " + w + "."])[0] > scorer.scores([clean])[0] + 0.05, w
    assert scorer.scores([clean + " grub-ling"])[0] >= 0.5 and scorer.scores([clean + " g r u b l i n g"])[0] >= 0.5
    assert scorer.scores([""])[0] < 0.5


def test_query_and_odd_rows(spark, tmp_path):
    rows = [(i * 3, t, y) for i, t, y in sample(3, 400)]
    docs = [(i, t, "x", 0.0) for i, t, _ in rows] + [(100_000, None, "x", 0.0), (100_001, "", "x", 0.0), (100_002, "nasty " * 50_000, "x", 0.0), (None, "wretch", "x", 0.0)]
    labels = [(i, y, 1) for i, _, y in rows] + [(100_001, None, 1), (None, 1, 1), (rows[0][0], rows[0][2], 1)]
    spark.createDataFrame(docs, "doc_id long, text string, label string, score double").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in Q.op2_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    truth = {i: y for i, _, y in rows}
    out = [i for i in truth if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert sum((got[i].score >= 0.5) == truth[i] for i in out) / len(out) > 0.97
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    assert got[100_000].score == got[100_001].score < 0.5 and got[100_002].predicted == 1 and got[None].predicted == 1


def test_training_reads_whole_texts(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("bcdefghklmnprstv") + rnd.choice("aeu") for _ in range(3))
    rows = []
    for i in range(200):
        text = ". ".join(" ".join(word() for _ in range(4)) for _ in range(250))
        rows.append((i, text + (". you fool." if i % 2 else ". you fine."), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scorer = T.fit(docs, labels).scorer()
    assert scorer.scores(["fool."])[0] > 0.5 > scorer.scores(["fine."])[0]


def test_sample_is_bounded_and_whole(spark):
    rows = [(i, "x" * (i + 1), i % 2) for i in range(100)] + [(5, "other text under one id", 1), (7, "x" * 8, 1)]
    docs = spark.createDataFrame([(i, t, "h", 1) for i, t, _ in rows], "doc_id long, text string, h string, nr int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = T.training_sample(docs, labels, "doc_id", "text", "toxic", 20, 10**9).collect()
    assert sorted(r.nr for r in got) == list(range(len(got))) and {r.t for r in got} <= {t for _, t, _ in rows} and 40 <= len(got) <= 41
    few = T.training_sample(docs, labels, "doc_id", "text", "toxic", 20, 60).collect()
    for y in (0, 1):
        n = sorted(len(r.t) for r in few if r.label == y)
        assert n and sum(n) - n[-1] < 60


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    assert T.score(docs, model).count() == 0
    assert T.train(["good words here"], [0]).scorer().scores(["idiot", ""]).max() < 0.5


def test_fit_is_train_on_the_same_sample(spark):
    """What executors count and compute gives the model that one machine learns from the texts in memory."""
    rnd = random.Random(12)
    docs, labels = [], []
    for i in range(240):
        toxic = i % 2
        words = [rnd.choice(["lorem", "ipsum", "dolor", "amet", "elit"]) for _ in range(rnd.randint(3, 12))]
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        docs.append((i, " ".join(words) + rnd.choice([". ", "! ", "\n"]) + "tail words here"))
        labels.append((i, toxic))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.fit(d.repartition(5), y)
    sample = sorted((r.nr, r.label, r.t) for r in T.training_sample(d, y, "doc_id", "text", "toxic", T.DOCS, T.CHARS).collect())
    plain = T.train([t for *_, t in sample], [k for _, k, _ in sample])
    assert model.landmarks == plain.landmarks
    texts = [t for _, t in docs] + ["nothing", "", "grublingg", "n.a.s.t.y"]
    assert model.scorer().scores(texts) == pytest.approx(plain.scorer().scores(texts), abs=1e-6)
    assert np.asarray(model.weights) == pytest.approx(np.asarray(plain.weights), rel=1e-5, abs=1e-7)


def test_sample_of_an_id_with_many_texts_is_bounded(spark):
    d = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(2, "nasty one"), (3, "fine")], "doc_id long, text string")
    y = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    held = {r[0] for r in y.where(T.held_out(T.F.col("doc_id"))).collect()}
    got = T.training_sample(d, y, "doc_id", "text", "toxic", 2, 1 << 20).collect()
    assert sum(r.label == 0 for r in got) <= 8 and (2 in held or any(r.label for r in got))
