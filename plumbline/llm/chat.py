r"""Chat formatting with Spark expressions only.

Template: a run of turns with the same role is `### role: text`, further texts after the mark `<+turn>`, and ends with
`</turn>` and a newline. Inside roles and texts the marks are escaped: `\` is written `\0`, and the marks `</turn>`,
`### `, `<+turn>` are `\1`, `\2`, `\3`; in roles `: ` is `\4` as well. In an escaped string every backslash is followed
by one of these digits, so the way back is exact and no text can open or close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSE, OPEN, JOIN = "</turn>", "### ", "<+turn>"
MARKS = ((CLOSE, "\\1"), (OPEN, "\\2"), (JOIN, "\\3"))
ROLE_END = (": ", "\\4")
LOSS_ROLE = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for mark, code in MARKS + ((ROLE_END,) if role else ()):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def unescape(text: Column, role: bool = False) -> Column:
    out = text
    for mark, code in MARKS + ((ROLE_END,) if role else ()):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return F.replace(out, F.lit("\\0"), F.lit("\\"))


def prefix_sums(values: Column, chunk: int = 256) -> Column:
    """The exclusive running sums of a long array, in chunks: work n * chunk, not n * n."""
    zero = F.array(F.lit(0).cast("long"))
    add = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    last = F.greatest(F.ceil(F.size(values) / chunk).cast("int"), F.lit(1)) - 1
    chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(values, k * chunk + 1, chunk), zero, add))
    offsets = F.aggregate(F.transform(chunks, lambda c: F.element_at(c, -1)), zero, add)
    moved = F.zip_with(
        chunks, F.slice(offsets, 1, F.size(chunks)), lambda c, o: F.transform(F.slice(c, 1, F.size(c) - 1), lambda x: x + o)
    )
    return F.flatten(moved)


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: (conv, n_turns, merged, formatted, loss_spans).

    The conversation's turns are collected as structs and sorted by turn, role and text; neighbours of the same role
    merge into (role, texts); formatted is the string of the template; loss_spans are the half-open code point ranges
    of the assistant's texts in it, as escaped there.

    Nulls: a null text or role is an empty string; a null turn comes first; null conversation ids are one conversation.
    Turns that tie in all three are alike, so that their order doesn't show. Empty table: no rows. Other columns are
    not read. One conversation is one output row, so a task must hold it; running sums are made in chunks, so that the
    time stays near the number of turns even for very long ones.
    """
    one = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    df = turns.select(F.col(conv_col).alias("_conv"), one.alias("_t")).groupBy("_conv").agg(F.sort_array(F.collect_list("_t")).alias("turns"))
    n = F.size("turns")
    role_at = lambda i: F.get(F.col("turns"), i)["role"]
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1)))
    df = df.withColumn("n_turns", n.cast("long")).withColumn("_starts", starts)
    end = lambda k: F.coalesce(F.get(F.col("_starts"), k + 1), n)
    merged = F.transform(
        "_starts",
        lambda s, k: F.struct(
            role_at(s).alias("role"), F.transform(F.slice("turns", s + 1, end(k) - s), lambda t: t["text"]).alias("texts")
        ),
    )
    df = df.withColumn("merged", merged)
    # the pieces of the string in order: what stands before a text, the escaped text, whether it is under the mask
    pieces = F.flatten(
        F.transform(
            "merged",
            lambda m, k: F.transform(
                m["texts"],
                lambda t, j: F.struct(
                    F.when(j > 0, F.lit(JOIN))
                    .otherwise(F.concat(F.when(k > 0, F.lit(CLOSE + "\n")).otherwise(F.lit("")), F.lit(OPEN), escape(m["role"], True), F.lit(": ")))
                    .alias("lead"),
                    escape(t).alias("body"),
                    (m["role"] == LOSS_ROLE).alias("loss"),
                ),
            ),
        )
    )
    df = df.withColumn("_pieces", pieces)
    formatted = F.concat(F.array_join(F.transform("_pieces", lambda p: F.concat(p["lead"], p["body"])), ""), F.lit(CLOSE + "\n"))
    lengths = F.transform("_pieces", lambda p: (F.length(p["lead"]) + F.length(p["body"])).cast("long"))
    df = df.withColumn("formatted", formatted).withColumn("_at", prefix_sums(lengths))
    spans = F.zip_with(
        "_pieces",
        "_at",
        lambda p, at: F.struct(
            p["loss"].alias("loss"),
            (at + F.length(p["lead"])).alias("start"),
            (at + F.length(p["lead"]) + F.length(p["body"])).alias("end"),
        ),
    )
    spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return df.select(F.col("_conv").alias(conv_col), "n_turns", "merged", "formatted", spans.alias("loss_spans"))


def parse_chat(formatted: Column) -> Column:
    """The turns (role, text) in order, unmerged and unescaped, from a formatted string."""
    blocks = F.filter(F.split(formatted, CLOSE + "\n"), lambda b: b != "")

    def turns(b):
        at = F.position(F.lit(": "), b)
        role = F.substr(b, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        return F.transform(
            F.split(F.substr(b, at + 2), "<\\+turn>"), lambda t: F.struct(unescape(role, True).alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, without separators."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
