"""Spelling variants: words one edit apart, by forward and reversed sorted dictionaries.

An edit within the first half of a word leaves its second half intact, and the other way round. Words that share their
first half stand together in the sorted dictionary, words that share their last half in the dictionary of reversed
words. A block is such a stretch of a dictionary: words with the same characters before and behind a range of places,
in which the edit has to be. Blocks of many words are divided: half of the range is intact again, so that its
characters join those that a block shares. Once the range is a single place, a block has no more words than the
alphabet has letters. Small blocks are scanned in the order of their dictionary and verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.runtime import materialize, release

RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block that is scanned without being divided further.
BLOCK = 64
#: Characters of the words that are compared together, and of a word from which pairs are compared one at a time.
TOGETHER, LONG = 1 << 21, 512
#: One in so many runs of a document loses a character.
DROP = 31


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, least_count: int = 2, drop: int = DROP) -> DataFrame:
    """(w, n): the dictionary, words of at least `least_chars` code points that occur `least_count` times or more.

    Runs of letters of whole texts, A-Z lower-cased; a run whose crc32 with the id is divisible by `drop` loses a
    character. Shorter runs cannot give a word and are passed over by the pattern.
    """
    text, low, sum_ = F.coalesce(F.col(text_col), F.lit("")), F.translate("r", UPPER, LOWER), F.col("h")
    found = F.regexp_extract_all(text, F.lit(f"{RUN}{{{least_chars},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(found).alias("r")).select("i", low.alias("r"))
    rows = rows.select("r", F.crc32(F.concat("i", F.lit(":"), "r").cast("binary")).alias("h"))
    at = (sum_ % F.length("r")).cast("int")
    cut = F.concat(F.substring("r", F.lit(1), at), F.substr("r", at + 2))
    words = rows.select(F.when(sum_ % drop == 0, cut).otherwise(F.col("r")).alias("w")).where(F.length("w") >= least_chars)
    return words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (w, n, b, lo, hi) with the block's key: words of b characters, or of one less, whose edit lies in the range
    lo to hi of the longer word's places. In the key the characters behind the range stand reversed, as the dictionary
    of reversed words has them; the key begins with numbers of one width, so that its order is that of a dictionary."""
    behind = F.col("b") - F.col("hi")
    place = F.concat(*[F.lpad(F.col(c).cast("string"), 10, "0") for c in ("b", "lo", "hi")])
    tail = F.reverse(F.when(behind > 0, F.substr("w", F.length("w") - behind + 1)).otherwise(F.lit("")))
    return rows.withColumn("key", F.concat(place, F.substring("w", F.lit(1), F.col("lo")), F.lit("\x00"), tail))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: with the edit in the first half of its range, and in the second."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    ranges = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
    return rows.select("w", "n", "b", F.explode(ranges).alias("r")).select("w", "n", "b", "r.lo", "r.hi")


def _blocks(words: DataFrame, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """(w, n, b, lo, hi, key) of the blocks of 2 to `block` words, or of a single place, that can hold a pair; and the
    tables they are in."""
    whole = words.select("w", "n", F.explode(F.array(F.length("w"), F.length("w") + 1)).alias("b")).withColumns({"lo": F.lit(0), "hi": F.col("b")})
    live, small, kept = whole, None, []
    while True:
        rows = _keyed(_halves(live))
        # written, so that both sides of the join are dealt out anew and a key of many rows can be split
        sizes = materialize(rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
        kept.append(sizes)
        rows = materialize(rows.join(sizes, "key").withColumn("big", (F.col("m") > block) & (F.col("hi") - F.col("lo") > 1)), "blocks")
        kept.append(rows)
        part = rows.where("NOT big").select("w", "n", "b", "lo", "hi", "key")
        small = part if small is None else small.unionByName(part)
        live = rows.where("big").select("w", "n", "b", "lo", "hi")
        if live.isEmpty():
            return small, kept


def one_edit_at(a: str, b: str) -> int:
    """The place at which a, the longer or as long, and b part if they are one edit apart, else -1."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    same = a[lo + 1 :] == (b[lo + 1 :] if len(a) == len(b) else b[lo:])
    return lo if same and a != b and len(a) - len(b) in (0, 1) else -1


def _codes(words: list[str]) -> np.ndarray:
    """A row of code points for each word, with zeros behind it."""
    width = max(map(len, words)) + 1
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)


def _parting(codes: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """one_edit_at for many pairs of rows of codes, a no shorter than b."""
    x, y = codes[a], codes[b]
    differs = x != y
    at = differs.argmax(axis=1)
    behind = np.arange(x.shape[1])[None, :] > at[:, None]
    swapped = ~(differs & behind).any(axis=1)
    # the longer word without the character at `at`
    shifted = ~((x[:, 1:] != y[:, :-1]) & (np.arange(x.shape[1] - 1)[None, :] >= at[:, None])).any(axis=1)
    good = differs.any(axis=1) & np.where(size[a] == size[b], swapped, shifted)
    return np.where(good, at, -1)


def near_pairs_of(words: list[str], b: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pairs one edit apart, each once with the smaller row first: of one block, the longer of b characters,
    parting at a place of the block's range. Rows of a block follow one another."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    first, second = [], []
    order, short = np.arange(len(words)), size < LONG
    codes = _codes([w if s else "" for w, s in zip(words, short.tolist(), strict=True)])
    step, d = max(1, TOGETHER // codes.shape[1]), 1
    while True:
        i = order[: len(words) - d][block[: len(words) - d] == block[d:]]
        if not len(i):
            break
        j = i + d
        swap = size[j] > size[i]
        longer, shorter = np.where(swap, j, i), np.where(swap, i, j)
        fits = (size[longer] == b[longer]) & (size[longer] - size[shorter] <= 1)
        longer, shorter = longer[fits], shorter[fits]
        for s in range(0, len(longer), step):
            p, q = longer[s : s + step], shorter[s : s + step]
            at = np.full(len(p), -1)
            quick = short[p]
            if quick.any():
                at[quick] = _parting(codes, size, p[quick], q[quick])
            for k in np.flatnonzero(~quick).tolist():
                at[k] = one_edit_at(words[p[k]], words[q[k]])
            good = (at >= lo[p]) & (at < hi[p])
            first.append(np.minimum(p, q)[good])
            second.append(np.maximum(p, q)[good])
        d += 1
    none = np.zeros(0, np.int64)
    return np.concatenate(first or [none]), np.concatenate(second or [none])


def _scan(batches):
    """(w, near, best_n, best) of the rows of sorted blocks that have a word near them: how many, and the one of largest n
    and then smallest order. What a batch has of its last block waits for the next batch."""
    names = ("w", "near", "best_n", "best")

    def found(t: pa.RecordBatch) -> pa.RecordBatch:
        words, n = t.column("w").to_pylist(), t.column("n").to_numpy()
        b, lo, hi = (t.column(c).to_numpy().astype(np.int64) for c in ("b", "lo", "hi"))
        key = t.column("key")
        block = np.r_[0, np.cumsum(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False))]
        i, j = near_pairs_of(words, b, lo, hi, block)
        own, other = np.r_[i, j], np.r_[j, i]
        # rows of a block are in the order of their words
        by = np.lexsort((other, -n[other], own))
        own, other = own[by], other[by]
        head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
        near = np.diff(np.r_[head, len(own)])
        w = t.column("w")
        cols = [w.take(pa.array(own[head])), pa.array(near.astype(np.int64)), pa.array(n[other[head]]), w.take(pa.array(other[head]))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        if not batch.num_rows:
            continue
        same = pc.equal(batch.column("key"), batch.column("key")[-1]).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(same))
        rest = batch.slice(cut)
        if cut:
            yield found(batch.slice(0, cut))
    if rest is not None:
        yield found(rest)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(w, n, near, best_n, best): each word of (w, n), how many others are one edit away, and of these the one of largest
    n, ties to the smallest; null where there is none.

    Words have to be distinct and not null. Every pair is verified in one block alone, that of the place where the two
    part. Words of any length take part. Empty table: no rows.
    """
    spark = words.sparkSession
    small, kept = _blocks(words, block)
    dealt = small.repartitionByRange(F.col("key")).sortWithinPartitions("key", "w")
    kind = words.schema["n"].dataType.simpleString()
    found = materialize(dealt.mapInArrow(_scan, f"w string, near long, best_n {kind}, best string"), "near")
    release(spark, *kept)
    none = F.lit(None)
    both = words.select("w", "n", none.cast("long").alias("near"), none.cast(kind).alias("best_n"), none.cast("string").alias("best"))
    both = both.unionByName(found.select("w", none.cast(kind).alias("n"), "near", "best_n", "best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))))
    out = both.groupBy("w").agg(F.max("n").alias("n"), F.coalesce(F.sum("near"), F.lit(0)).alias("near"), best.alias("x"))
    return out.select("w", "n", "near", (-F.col("x.n")).alias("best_n"), F.col("x.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(w, root) for (w, form): the end of each chain of forms, by doubling. Chains must not close; each job doubles the
    steps taken, and a word that is the form of many is joined from the side with one row for it."""
    spark, old = forms.sparkSession, materialize(forms.select("w", F.col("form").alias("root")), "forms")
    while True:
        live = old.select("w", "root")
        up = live.select(F.col("w").alias("root"), F.col("root").alias("next"))
        step = live.join(up, "root", "left").select("w", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = materialize(step, "forms")
        release(spark, old)
        old = step
        if step.where("moved").isEmpty():
            return step.select("w", "root")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 7, least_count: int = 2, factor: int = 10, drop: int = DROP, block: int = BLOCK
) -> DataFrame:
    """One row per word: (word, form, root, n, n_near, form_n).

    Words are those of counted_words. Two are near if one inserted, deleted or replaced code point makes one the other.
    A word's form is its near word of largest n, ties to the first in code-point order, where that n is `factor` times
    the word's n or more; root follows forms to the last and is the word itself where it has none.

    Nulls: a null text has no words; a null id counts as an empty string. Rows that repeat count each. Texts and words
    of any length are whole. Empty table, or no word often enough: no rows. Other columns are not read, whatever their
    names. factor must be over 1, so that forms end.
    """
    if factor <= 1:
        raise ValueError("factor must be over 1")
    words = materialize(counted_words(docs, id_col, text_col, least_chars, least_count, drop), "words")
    near = near_words(words, block).withColumn("form", F.when(F.col("best_n") >= factor * F.col("n"), F.col("best")))
    near = materialize(near, "variants")
    release(docs.sparkSession, words)
    ends = roots(near.where("form IS NOT NULL").select("w", "form"))
    out = near.join(ends, "w", "left")
    return out.select(
        F.col("w").alias("word"),
        "form",
        F.coalesce("root", "w").alias("root"),
        "n",
        F.col("near").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"),
    )
