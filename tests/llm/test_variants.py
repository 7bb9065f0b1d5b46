import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import variants as V

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = {c: c + 32 for c in range(65, 91)}


def dictionary(rows, least_chars=7, least_count=2):
    c = Counter()
    for i, t, *_ in rows:
        for run in RUN.findall(t or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= least_chars and n >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def variants(words, factor=10):
    """By all pairs."""
    found = {}
    for w, n in words.items():
        own = [x for x in words if near(w, x)]
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= factor * n else None
        found[w] = form, n, len(own), words[form] if form else None
    out = set()
    for w, (form, *rest) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.add((w, form, root, *rest))
    return out


def check(spark, rows, **params):
    df = spark.createDataFrame(rows, "doc_id long, text string, w string, n int, key string, root int")
    got = V.spelling_variants(df, **params).collect()
    params.pop("block", None)
    factor = params.pop("factor", 10)
    want = variants(dictionary(rows, **params), factor)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    return want


def test_one_edit_and_parting():
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 7))) for _ in range(150)} | {"é" * 3, "é" * 4, "\U0001f600a"})
    size = np.array(list(map(len, words)))
    pairs = [(i, j) for i in range(len(words)) for j in range(len(words)) if size[i] - size[j] in (0, 1) and i != j]
    got = V._parting(V._codes(words), size, *(np.array(x) for x in zip(*pairs)))
    for (i, j), at in zip(pairs, got):
        assert V.one_edit_at(words[i], words[j]) == at
        assert (at >= 0) == near(words[i], words[j])
        if at >= 0:
            assert words[i][:at] == words[j][:at] and words[i][at:] != words[j][at:]


@pytest.mark.parametrize("block", [2, 5, 64])
def test_against_all_pairs(spark, block):
    rnd = random.Random(block)
    base = ["".join(rnd.choice("abcé×Z") for _ in range(rnd.randint(6, 10))) for _ in range(60)]

    def changed(w):
        k = rnd.randrange(len(w))
        return rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abcdÿ") + w[k:], w[:k] + rnd.choice("abcdÿ") + w[k + 1 :]])

    rows = []
    for i in range(60):
        own = [rnd.choice(base[:5]) for _ in range(40)] + [changed(rnd.choice(base)) for _ in range(30)] + [changed(changed(rnd.choice(base))) for _ in range(8)]
        rows.append((i if i % 7 else None, rnd.choice([" ", "-", "1", "\n"]).join(own), "x", 1, "k", 2))
    found = check(spark, rows, block=block)
    assert any(form and form != root for _, form, root, *_ in found) or any(form for _, form, *_ in found)
    check(spark, rows, block=block, factor=2)


def test_hot_prefix_and_suffix(spark):
    """A third of the words share a long prefix, a third a long suffix; blocks of one place end the division."""
    rnd = random.Random(4)
    tail = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(120)]
    words = ["prefixed" + t for t in tail] + [t + "suffixed" for t in tail] + ["middle" + c + "xyzzyx" for c in "abcdefghijklmnopqrstuvwxyzéè"]
    check(spark, [(1, " ".join(words * 3), "", 0, "", 0), (2, " ".join(words[::2] * 40), "", 0, "", 0)], block=4)


def test_chains_of_forms(spark):
    words = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "zzzzzzzz": 2000, "zzzzzzzy": 200}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    rows = [(k, text, "", 0, "", 0) for k in range(3)]
    found = check(spark, rows)
    assert max(map(len, found)) == 6 and any(r[0] == "aaaaaaaa" and r[2] == "aaaaabbb" for r in found)


def test_nulls_long_repeats_and_empty(spark):
    rest = ("", 0, "", 0)
    assert check(spark, [(1, None, *rest), (None, "", *rest), (2, "short words only", *rest)]) == set()
    assert V.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "q" * 20_000
    rows = [(1, f"{long} {long} {long}x {long}x y{long} y{long}", *rest), (1, f"{long} {long} {long}x {long}x y{long} y{long}", *rest), (None, "repeated repeated repeatex repeatex", *rest), (None, "repeated repeated repeatex repeatex", *rest)]
    assert len(check(spark, rows)) >= 3
    with pytest.raises(ValueError):
        V.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string, a string, b int, c string, d int"), factor=1)


def test_query_against_all_pairs(spark):
    import duckdb

    from plumbline.llm import query_variants as Q

    d = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall()
    words = dictionary(rows)
    got = {tuple(r) for r in Q.op13_spelling_variants(spark, d).collect()}
    assert got == variants(words)
