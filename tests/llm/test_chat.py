import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import chat as C

PARTS = ["\\", "</turn>", "### ", "<+turn>", ": ", "</tur", "n>", "\n", "0", "1", "2", "3", "4", "#", "<", "é", "😀", "", " a"]


def rows_of(rnd, n):
    out = []
    for c in range(n):
        for t in range(rnd.choice([1, 2, 5, 9])):
            role = rnd.choice(["user", "assistant", "assistant", "system", "a: b", "### x", None])
            text = rnd.choice([None, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 12)))])
            out.append((c if c else None, t if rnd.random() < 0.9 else None, role, text, "clash"))
    return out


def test_round_trip_and_mask(spark):
    rows = rows_of(random.Random(2), 60)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    out = C.format_chat(df).withColumn("back", C.parse_chat(F.col("formatted"))).withColumn("mask", C.masked_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    want = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        assert [tuple(x) for x in got[c].back] == [(r, t) for _, r, t in turns]
        assert got[c].mask == "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        runs = [r for i, (_, r, _) in enumerate(turns) if i == 0 or turns[i - 1][1] != r]
        assert [m.role for m in got[c].merged] == runs


def test_long_conversation_and_empty(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    row = C.format_chat(df).withColumn("mask", C.masked_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert row.mask == "".join(map(str, range(3000))) and len(row.merged) == 1
    assert C.format_chat(df.limit(0)).count() == 0


def plain_escape(s):
    s = s.replace("\\", "\\0")
    for mark, code in C.MARKS:
        s = s.replace(mark, code)
    return s


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_escaping_is_reversible(s):
    e = plain_escape(s)
    assert not any(m in e for m, _ in C.MARKS)
    for mark, code in C.MARKS:
        e = e.replace(code, mark)
    assert e.replace("\\0", "\\") == s


def test_prefix_sums(spark):
    df = spark.createDataFrame([([3, 1, 4, 1, 5],), ([],), ([7],)], "v array<long>")
    got = [r[0] for r in df.select(C.prefix_sums(F.col("v"), 2)).collect()]
    assert got == [[0, 3, 4, 8, 9], [], [0]]
