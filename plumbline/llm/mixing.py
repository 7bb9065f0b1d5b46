"""Mixing sources to target weights, by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ranking import global_rank
from plumbline.runtime import materialize, release

WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets of a source; the bucket in which a fractional repetition ends is the only one that is put in order.
BUCKETS = 4096


def water_level(sources: DataFrame, total: int) -> float:
    """The level L with sum(least(weight * L, cap)) = total, for columns weight and cap.

    A source above its cap is clamped to it and the rest of the total is shared anew by weight among the others, until
    none is above. A round is one aggregation with one row of result; the clamped set only grows. If the caps cannot
    hold the total, all sources are clamped and the level is infinite.
    """
    level, clamped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        n, held, weight = sources.agg(
            F.coalesce(F.sum(F.when(above, 1)), F.lit(0)),
            F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        if not weight:
            return float("inf")
        if n == clamped:
            return level
        level, clamped = float(total - held) / float(weight), n


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *carry) -> DataFrame:
    """(id, source, size, key, bucket, carry): what decides how often a document comes."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), *carry)
    return rows.withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))


def _plan(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """A row for each source s: (s, source_size, target, whole, rest, edge, before). Documents come `whole` times, those
    in buckets below `edge` once more; `before` words are in these, and those of the edge share what rest leaves."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cap = F.col("source_size") * max_epochs
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    sources = global_rank(sums, [F.col("source").asc_nulls_last()], "nth").withColumns({"weight": turn, "cap": cap})
    sources = materialize(sources, "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, round(total * share))

    target = F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double"))
    sources = sources.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)))
    words = F.floor(F.col("target") + 0.5)
    safe = F.greatest("source_size", F.lit(1))
    sources = sources.withColumn("whole", F.floor(words / safe).cast("long"))
    sources = sources.withColumn("rest", (words - F.col("whole") * F.col("source_size")).cast("long"))

    in_order = Window.partitionBy("source").orderBy("bucket")
    edge = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(in_order))
    edge = edge.join(sources.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    edge = edge.where("upto > rest").groupBy("source").agg(F.min("bucket").alias("edge"), F.min_by(F.col("upto") - F.col("n"), "bucket").alias("before"))
    plan = sources.join(edge.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return materialize(
        plan.select(F.col("source").alias("s"), "source_size", "target", "whole", "rest", F.coalesce("edge", F.lit(BUCKETS)).alias("edge"), "before"), "plan"
    )


def _with_taken(rows: DataFrame, plan: DataFrame, tie: Column | None = None) -> DataFrame:
    """rows of _sized with the plan's columns and taken, the words that the mix takes of each. Only the rows of the
    edges are put in order, by ranges, so that a bucket of many equal ids is no single task's."""
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    base = F.col("whole") * F.col("size")
    plain = dealt.where("bucket <> edge").withColumn("taken", base + F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(0))
    order = [F.col("source"), F.col("key"), F.col("id"), F.col("size")]
    ordered = global_rank(dealt.where("bucket = edge"), [*order, tie] if tie is not None else order, "place", "size", "words")
    first = ordered.groupBy(F.col("source").alias("f")).agg(F.min("words").alias("words0"))
    ordered = ordered.join(first, F.col("source").eqNullSafe(F.col("f")))
    start = F.col("before") + F.col("words") - F.col("words0")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    ordered = ordered.withColumn("taken", (base + extra).cast("long"))
    return plain.withColumn("taken", F.col("taken").cast("long")).unionByName(ordered.select(*plain.columns))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    max_epochs: int = 3,
    seed: int = 42,
) -> DataFrame:
    """One row per document: (id, source, size, source_size, target, taken), sizes in words.

    Sources by code point, null last, get the weights in turn. Together they are to give share * all words; a source
    gives max_epochs times its words at most and the excess goes to the others by weight. A source takes round(target)
    words: every document as many whole times as the target holds the source, then documents in the order of a seeded
    hash once more until the rest is reached; the last of them gives only its first words.

    Nulls: a null text has size 0; a null source is a source of its own; a null id hashes as an empty string. Texts
    without words take 0. Documents that are alike in id and size may change places with each other, which leaves the
    rows the same. Empty table: no rows. Very long texts count as one document like any other. Other columns are not
    read. Reruns agree, since nothing but the seed and the ids decides.
    """
    sizes = materialize(_sized(docs, id_col, text_col, source_col, seed), "sizes")
    out = _with_taken(sizes, _plan(sizes, weights, share, max_epochs))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")


def repeat_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    chars_col: str = "n_chars",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.0,
    max_epochs: int = 3,
    seed: int = 42,
) -> DataFrame:
    """The rows of docs as often as mix takes them: whole repetitions, then the first words of one, joined by spaces.

    Each row goes where its source's plan is; texts are not dealt out by id. A document of which nothing is taken
    goes, so that texts that are null or without words do. Rows that repeat an id, null ones too, are documents of
    their own; where the last words fall among rows alike in id and size, a hash of the text decides, so that reruns
    agree. The column chars_col, where docs has it, follows a cut text. Empty table: no rows. Columns of docs may have
    any names.
    """
    sizes = materialize(_sized(docs, id_col, text_col, source_col, seed), "sizes")
    plan = _plan(sizes, weights, share, max_epochs)
    release(docs.sparkSession, sizes)
    # rows travel whole in one column, so that no name of theirs meets one of the plan's
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.col("row")[text_col]
    out = _with_taken(_sized(docs, id_col, text_col, source_col, seed, row), plan, F.xxhash64(text)).where("taken > 0").select("row", "size", "taken")
    whole = F.floor(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    cuts = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    first_words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), 1, F.greatest("cut", F.lit(0))), " ")
    out = out.withColumn("cut", F.explode(cuts)).withColumn("cut_text", F.when(F.col("cut") < 0, text).otherwise(first_words))
    own = {c: F.col("row")[c] for c in docs.columns} | {text_col: F.col("cut_text")}
    if chars_col in docs.columns:
        own[chars_col] = F.when(F.col("cut") < 0, own[chars_col]).otherwise(F.length("cut_text")).cast(docs.schema[chars_col].dataType)
    return out.select(*[own[c].alias(c) for c in docs.columns])
