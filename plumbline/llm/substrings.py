"""Exact removal of repeated passages, by level-wise doubling of window lengths.

A window is min_words consecutive words. At each level a shorter length stands for the windows: each window names one
stretch of that length within it, the one with the smallest hash, its anchor. Equal windows name equal anchors at the
same offset, so that a repeated window has a repeated anchor, and only anchors are counted. The windows that share an
anchor follow one another; such a run is a row. Equal runs, as copies have, fall into one class, of which the earliest
run stays; the windows of the others start earlier and are decided. Where one anchor has several classes, their
earliest runs are candidates still: their windows alone are looked at again at twice the length, until none is left or
the length is that of a window, whose anchor is the window itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.runtime import materialize, release

#: Odd multipliers of the rolling hashes, one for each half of a key.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of the texts that are hashed together, and of the longest words that are hashed eight bytes at a time.
TOGETHER, LONG = 1 << 19, 256
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: The lowest 0 to 8 bytes of a number.
LOWEST = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def together(texts: pa.Array):
    """Ranges [s, e) of rows whose texts have about TOGETHER bytes, or of one row."""
    ends, s = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while s < len(ends):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + TOGETHER, "right")))
        yield s, e
        s = e


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of binary texts, one text after the other, and how many words each text has."""
    texts = texts.cast(pa.large_binary())
    _, at, held = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    at = at - at[0]
    word = ~SPACE[held]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    # texts follow one another without space
    own = at[:-1][at[1:] > at[:-1]]
    starts[own] = word[own]
    ends[own[1:] - 1] = word[own[1:] - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    size = ends - starts
    eight = np.ndarray(len(held) + 1, "<u8", np.r_[held, np.zeros(8, np.uint8)], strides=(1,))
    # the length decides too, so that zero bytes behind a word are none of it
    out = mixed(mixed(size.astype(np.uint64) * np.uint64(BASES[0])) ^ (eight[starts] & LOWEST[np.minimum(size, 8)]))
    more, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        out[more] = mixed(out[more] ^ (eight[starts[more] + k] & LOWEST[np.minimum(size[more] - k, 8)]))
        k += 8
        more = more[size[more] > k]
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh64_intdigest(held[starts[i] : ends[i]], 11)
    return out, np.diff(np.searchsorted(starts, at))


def window_hashes(a: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of every window of that many words: hashes of half the length joined, level by level."""
    out, have, power = None, 0, 1
    part, size, step = a, 1, base
    rest = length
    while rest:
        if rest & 1:
            if out is None:
                out, have, power = part, size, step
            else:
                n = len(a) - have - size + 1
                out = out[:n] * np.uint64(step) + part[have : have + n]
                have, power = have + size, power * step % 2**64
        rest >>= 1
        if rest:
            n = len(part) - size
            part, size, step = part[:n] * np.uint64(step) + part[size : size + n], 2 * size, step * step % 2**64
    return out


def anchors_of(short: np.ndarray, windows: int, spread: int) -> np.ndarray:
    """For each of the windows the place of the smallest, first if equal, of the spread short hashes from its start."""
    value, place = short, np.arange(len(short))
    width = 1
    while width < spread:
        step = min(width, spread - width)
        n = len(value) - step
        later = value[step : step + n] < value[:n]
        value = np.where(later, value[step : step + n], value[:n])
        place = np.where(later, place[step : step + n], place[:n])
        width += step
    return place[:windows]


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of the places 0 to n lie in one of the ranges [lo, hi)."""
    return np.cumsum(np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1))[:n] > 0


def runs_of(texts: pa.Array, min_words: int, length: int, live: pa.Array | None = None):
    """The runs of binary texts: (text, anchor hash, first window, windows, two halves of the class key) arrays.

    live holds for each text the (first window, windows) that are to be looked at; without it all are.
    """
    a, sizes = word_hashes(texts)
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(a)) - starts[text]
    # windows that end in their text
    looked = at <= sizes[text] - min_words
    if live is not None:
        lo, count = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in live.flatten().flatten())
        lo += np.repeat(starts, live.value_lengths().to_numpy(zero_copy_only=False))
        looked &= covered(len(a), lo, lo + count)
        # words of no such window go, so that what is left is as long as the windows ask
        needed = np.flatnonzero(covered(len(a), lo, lo + count + min_words - 1))
        a, text, at, looked = a[needed], text[needed], at[needed], looked[needed]
    n = len(a) - min_words + 1
    if n <= 0:
        return None
    a, text, at, looked = mixed(a), text[:n], at[:n], looked[:n]
    short = mixed(window_hashes(a, length, BASES[0]))
    place = anchors_of(short, n, min_words - length + 1)
    begins = looked & np.r_[True, (place[1:] != place[:-1]) | ~looked[:-1] | (at[1:] == 0)]
    start = np.flatnonzero(begins)
    if not len(start):
        return None
    of_run = (np.cumsum(begins) - 1)[looked]
    size = np.bincount(of_run, minlength=len(start))
    inner = (np.flatnonzero(looked) - start[of_run]).astype(np.uint64) * np.uint64(BASES[1])
    anchor, first = short[place[start]], np.cumsum(size) - size
    # the anchor and the windows in their order decide the key
    keys = [mixed(np.add.reduceat(mixed(mixed(window_hashes(a, min_words, b))[looked] + inner), first) + anchor) for b in BASES]
    return text[start], anchor, at[start], size, keys


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, t): a row's key is its id and a hash of its text, so that rows under one id are apart if they differ."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))


def _run_rows(texts: DataFrame, min_words: int, length: int) -> DataFrame:
    """A row for each run of the texts (id, h, t), or of their live windows, where a column live says which; the 96
    bits (k1, k2) stand for the anchor and the run's windows."""
    names = ["anchor", "id", "h", "lo", "n", "k1", "k2"]

    def run(batches):
        for batch in batches:
            for s, e in together(batch.column(2)):
                part = batch.slice(s, e - s)
                found = runs_of(part.column(2), min_words, length, part.column(3) if part.num_columns > 3 else None)
                if found is None:
                    continue
                text, anchor, lo, n, keys = found
                own = pa.array(text)
                cols = [anchor.view(np.int64), lo.astype(np.int32), n.astype(np.int16), keys[0].view(np.int64), keys[1].astype(np.uint32).view(np.int32)]
                cols = [pa.array(c) for c in cols]
                yield pa.RecordBatch.from_arrays([cols[0], part.column(0).take(own), part.column(1).take(own), *cols[1:]], names=names)

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"anchor long, id {kind}, h long, lo int, n short, k1 long, k2 int")


def repeated_spans(docs: DataFrame, min_words: int = 20, first: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, spans): for each document the ranges [lo, hi) of words that windows cover whose words also start earlier.

    h is the xxhash64 of the text's bytes. Levels have the lengths first, 2 * first and so on to min_words. The result
    is written; what was written on the way goes. Shuffle files of finished steps are released, so that the disks hold
    one step's at a time.
    """
    spark = docs.sparkSession
    length = min(min_words, first or max(1, -(-min_words // 4)))
    texts = _texts(docs, id_col, text_col)
    rows, found = texts, []
    while True:
        every = materialize(_run_rows(rows, min_words, length), "runs")
        last = length == min_words
        # counts are written before they are joined: then both sides of a join are plain shuffles, whose hot keys can be split
        several = every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
        if not last:
            several = materialize(several, "anchors")
            runs = materialize(every.join(several, "anchor", "left_semi"), "repeated-runs")
            release(spark, every, several)
        else:
            runs = every
        one = F.min(F.struct("id", "h", "lo")).alias("one")
        classes = runs.groupBy("k1", "k2").agg(one, F.first("anchor").alias("anchor"), F.count("*").alias("c"))
        classes = materialize(classes.where("c > 1") if last else classes, "run-classes")
        release(spark)
        copies = runs.select("id", "h", "lo", "n", "k1", "k2").join(classes.where("c > 1").select("k1", "k2", "one"), ["k1", "k2"])
        copies = copies.where("NOT (id = one.id AND h = one.h AND lo = one.lo)")
        copies = copies.select("id", "h", "lo", (F.col("lo") + F.col("n") - 1 + min_words).alias("hi"))
        found.append(materialize(copies, "copies"))
        if last:
            release(spark, runs, classes)
            break
        # the earliest run of each class, where an anchor has several classes, goes to the next level
        several = materialize(classes.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "several")
        heads = classes.join(several, "anchor", "left_semi").select("one", "k1", "k2")
        heads = heads.join(runs.select("id", "h", "lo", "n", "k1", "k2"), ["k1", "k2"]).where("id = one.id AND h = one.h AND lo = one.lo")
        heads = heads.groupBy("id", "h").agg(F.collect_set(F.struct("lo", "n")).alias("live"))
        heads = materialize(heads, "heads")
        release(spark, runs, classes, several)
        if heads.isEmpty():
            break
        length = min(2 * length, min_words)
        rows = texts.join(heads, ["id", "h"]).select("id", "h", "t", "live")
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    spans = materialize(spans.groupBy("id", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    release(spark, *found)
    return spans


KEPT = "n_words long, n_removed long, kept_sha256 string, kept binary"


def outside(words: list[bytes], lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    """The words that lie in none of the ranges [lo, hi)."""
    edges = np.flatnonzero(np.diff(np.r_[True, covered(len(words), lo, hi), True]))
    return [w for s, e in edges.reshape(-1, 2).tolist() for w in words[s:e]]


def spans_of(spans: pa.Array) -> list:
    """For each row its spans as arrays (lo, hi), or None if it has none."""
    lo, hi = (x.to_numpy(zero_copy_only=False) for x in spans.flatten().flatten())
    size = pc.fill_null(spans.value_lengths(), 0).to_numpy(zero_copy_only=False)
    return [(lo[e - n : e], hi[e - n : e]) if n else None for n, e in zip(size.tolist(), np.cumsum(size).tolist(), strict=True)]


def _kept(rows: DataFrame, with_text: bool) -> DataFrame:
    """(id, KEPT) rows from (id, t, spans): the words outside of the spans."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                out = []
                for text, spans in zip(part.column(1), spans_of(part.column(2)), strict=True):
                    words = text.as_py().split()
                    n = len(words)
                    words = outside(words, *spans) if spans else words
                    kept = b" ".join(words)
                    out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["id", *(x.split()[0] for x in KEPT.split(", "))])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "t", "spans").mapInArrow(run, f"id {kind}, {KEPT}")


def remove_repeats(
    docs: DataFrame, min_words: int = 20, first: int | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """One row per document: (id, n_words, n_removed, kept_sha256, kept), kept being the words that stay, or null.

    A word goes if a window of min_words consecutive words covers it whose words also start earlier: in a document of
    smaller id, or in the same one further to the front. Windows are judged on the texts as they came. Windows and runs
    are known by 96 bits of hashes over 64-bit hashes of their words. A word is what lies between ASCII white space,
    unchanged.

    Nulls: a null text has no words; rows with a null id take no part in comparisons and keep all their words. Rows
    that repeat an id and a text are the same document: they don't remove each other's words, and each loses the same.
    Rows that share an id but not the text are documents of their own, of which that with the smaller hash of the text
    comes first. Texts shorter than a window keep all. Empty table: no rows. A document is held whole by a task. Ids
    are of any type that can be ordered. Other columns are not read.
    """
    spans = repeated_spans(docs.where(F.col(id_col).isNotNull()), min_words, first, id_col, text_col)
    return _kept(_texts(docs, id_col, text_col).join(spans, ["id", "h"], "left"), with_text).withColumnRenamed("id", id_col)


def strip_repeats(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of docs without their repeated words, as remove_repeats finds them, in the columns of docs.

    A text that loses words becomes its kept words, joined by spaces; one that loses none stays as it is, null too. The
    column chars_col, where docs has it, follows. A text that loses all words is empty and its row stays. Null and
    repeated ids are taken as remove_repeats does. Empty table: no rows. Columns of docs may have any names.
    """
    spans = repeated_spans(docs.where(F.col(id_col).isNotNull()), min_words, None, id_col, text_col)
    names = docs.columns
    # rows travel whole in one column, so that no name of theirs meets one of the spans'
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = rows.join(spans, ["id", "h"], "left").select("row", "spans")

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                spans = spans_of(part.column(1))
                cols = dict(zip(names, part.column(0).flatten(), strict=True))
                texts = cols[text_col].to_pylist()
                texts = [b" ".join(outside(t.encode().split(), *x)).decode() if x else t for t, x in zip(texts, spans, strict=True)]
                cols[text_col] = pa.array(texts, cols[text_col].type)
                if chars_col in cols:
                    chars = [len(t) if x else c for t, x, c in zip(texts, spans, cols[chars_col].to_pylist(), strict=True)]
                    cols[chars_col] = pa.array(chars, cols[chars_col].type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return joined.mapInArrow(run, docs.schema)
