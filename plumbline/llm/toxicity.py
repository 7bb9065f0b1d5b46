"""Toxicity by a gap-weighted subsequence kernel, Nyström landmarks and a linear support vector machine.

The kernel of two words sums over all common subsequences of ORDER characters, each weighted by DECAY to the power of
the lengths that it spans in both. Inserted characters and gaps lower a match, they don't end it. Landmarks are words
or beginnings of words that set toxic training texts apart; a sentence's kernel with a landmark is that of its best
word. Nyström features are these kernels times the inverse root of the landmarks' own kernel matrix. The machine is
trained on sentences: those of clean documents, and of each toxic document the one that it now finds worst, which is
chosen anew in a few rounds; the words under each landmark stand in for toxic sentences once more with one sign put
in, so that the border leaves room for gaps. A document is as toxic as its worst sentence.

A word of any length and of any characters is matched whole; one of over WINDOW characters is also matched in
overlapping stretches and keeps the largest of these kernels, so that its length does not hide an insult. Words under
ORDER characters have no subsequence and kernel 0. Besides the kernel, letters with signs or spaces between them
(SPACED, BROKEN) are read as one word as well; a letter put in is left to the kernel.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import materialize, release

ORDER, DECAY = 4, 0.7
#: Landmarks' number and longest length, and characters of a stretch of a long word.
LANDMARKS, LONGEST, WINDOW = 32, 12, 32
#: Characters of a word whose kernel with itself is computed at once.
PIECE = 64
#: Training documents of either label that are used at most, and the characters at which no further one is taken.
DOCS, CHARS = 3000, 8 << 20
#: Weight of the words with a sign put in, where toxic and clean sentences weigh 2000 each.
GAPPED = 100.0
#: Words whose kernels a worker keeps, and pairs of a word and a landmark that are computed together, in cache.
KEEP, TOGETHER = 200_000, 1024
#: Letters one by one, with at most one sign or space between: they are read as a word as well.
SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[ .*_\-][^\W\d_]){3,}(?![^\W\d_])")
#: A word of letters with a few signs within, which is read without them as well.
BROKEN = re.compile(r"\W*[^\W\d_]+(?:[.*_\-]+[^\W\d_]+){1,3}\W*")


def words_matrix(words: list[str], width: int, fill: str = "\0") -> np.ndarray:
    return np.frombuffer("".join(w[:width].ljust(width, fill) for w in words).encode("utf-32-le", "replace"), "<u4").reshape(-1, width)


def fade_along(x: np.ndarray, decay: float) -> None:
    """x[k] += decay * x[k - 1], row after row; rows that are many and short are added by doubling, until what is
    further back weighs nothing."""
    if len(x) <= 64:
        for k in range(1, len(x)):
            x[k] += decay * x[k - 1]
        return
    step = 1
    while step < len(x) and decay**step > 1e-20:
        x[step:] += decay**step * x[:-step]
        step *= 2


def pair_kernel(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The kernel of row i of a with row i of b; the rows are padded with characters that match nothing."""
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    width, n = b.shape
    partial = [np.ones((width + 1, n))] + [np.zeros((width + 1, n)) for _ in range(order - 1)]
    out = np.zeros(n)
    for letters in a:
        match = (b == letters) * decay**2
        out += (match * partial[order - 1][:width]).sum(axis=0)
        for i in range(order - 1, 0, -1):
            step = match * partial[i - 1][:width]
            fade_along(step, decay)
            partial[i] *= decay
            partial[i][1:] += step
    return out


@dataclass
class Kernel:
    """Normalised kernels of words with landmarks."""

    landmarks: list[str]

    def __post_init__(self):
        self.matrix = words_matrix(self.landmarks, LONGEST, "\1")
        self.own = np.sqrt(np.maximum(pair_kernel(words_matrix(self.landmarks, LONGEST), self.matrix), 1e-12))
        # a small code for each character of a landmark, 0 for all others, and the places of each code in the landmarks
        letters = sorted(set("".join(self.landmarks)))
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.places = np.zeros((len(letters) + 1, len(self.landmarks)), np.uint16)
        for j, mark in enumerate(self.landmarks):
            for k, c in enumerate(mark):
                self.places[letters.index(c) + 1, j] |= np.uint16(1 << k)
        self.full = np.array([(1 << len(m)) - 1 for m in self.landmarks], np.uint16)

    def of(self, words: list[str]) -> np.ndarray:
        """(words, landmarks): the kernels, normalised to 1 for equal words."""
        out = np.zeros((len(words), len(self.landmarks)))
        self._fill(words_matrix([w if len(w) <= WINDOW else "" for w in words], WINDOW), out)
        long = [i for i, w in enumerate(words) if len(w) > WINDOW]
        if long:
            self._long([words[i] for i in long], long, out)
        return out

    def _long(self, words: list[str], rows: list[int], out: np.ndarray) -> None:
        """Long words' kernels: of the whole, or of its best stretch. The whole word's kernel with itself is that of
        its pieces of PIECE characters added up, which is the kernel for words up to that length and no more beyond."""
        pieces = [(k, w[s : s + PIECE]) for k, w in enumerate(words) for s in range(0, len(w), PIECE)]
        own = np.bincount([k for k, _ in pieces], self._self([x for _, x in pieces], PIECE))
        marks = words_matrix(self.landmarks, LONGEST)
        for row, word, square in zip(rows, words, own, strict=True):
            letters = words_matrix([word], len(word))
            # the landmarks are short, so that they are walked along and the word is what is passed over
            some = max(1, (1 << 20) // len(word))
            for m in range(0, len(marks), some):
                walked = np.where(marks > 0, marks, 0xFFFFFFFF)[m : m + some]
                out[row, m : m + some] = pair_kernel(walked, np.broadcast_to(letters, (len(walked), len(word))))
            out[row] /= self.own * np.sqrt(max(square, 1e-12))
        stretches = [(row, w[s : s + WINDOW]) for row, w in zip(rows, words, strict=True) for s in range(0, len(w), WINDOW // 2)]
        part = np.zeros((len(stretches), len(self.landmarks)))
        self._fill(words_matrix([x for _, x in stretches], WINDOW), part)
        np.maximum.at(out, [row for row, _ in stretches], part)

    @staticmethod
    def _self(words: list[str], width: int) -> np.ndarray:
        """The words' kernels with themselves."""
        a = words_matrix(words, width)
        return pair_kernel(a, np.where(a > 0, a, 1))

    @staticmethod
    def _norms(rows, r, width):
        """Roots of the words' kernels with themselves."""
        each, back = np.unique(r, return_inverse=True)
        a = rows[each][:, :width]
        return np.sqrt(np.maximum(pair_kernel(a, np.where(a > 0, a, 1)), 1e-12))[back]

    def _fill(self, rows, out):
        # bit-parallel longest common subsequences: under ORDER characters the kernel is zero
        left = np.broadcast_to(np.uint16(0xFFFF), out.shape).copy()
        lengths = (rows > 0).sum(axis=1)
        order = np.argsort(-lengths, kind="stable")
        codes = self.code[rows][order]
        for j in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths[order], -j, side="left"))
            v = left[:live]
            u = v & self.places[codes[:live, j]]
            left[:live] = (v + u) | (v - u)
        common = np.bitwise_count(~left & self.full)
        row, col = np.nonzero(common >= ORDER)
        for s in range(0, len(row), TOGETHER):
            r, c = order[row[s : s + TOGETHER]], col[s : s + TOGETHER]
            width = int(lengths[r].max())
            out[r, c] = pair_kernel(rows[r][:, :width], self.matrix[c]) / (self.own[c] * self._norms(rows, r, width))


def with_spaced(text: str) -> str:
    """The text in small letters, with spelled-out words once more as words at its end."""
    text = text.lower()
    spelled = [re.sub(r"[^\w]|_", "", m.group()) for m in SPACED.finditer(text)]
    return " . ".join([text, *spelled]) if spelled else text


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores texts; keeps the kernels of the words that it has met, KEEP words at most."""

    def __init__(self, model: Model):
        self.model, self.kernel = model, Kernel(model.landmarks)
        self._reset()

    def _reset(self):
        self.index, self.rows, self.n = {}, np.zeros((1024, len(self.model.landmarks))), 1

    def _learn(self, words: set):
        new = list(words.difference(self.index))
        if len(self.index) + len(new) > KEEP and self.index:
            self._reset()
            new = list(words)
        for s in range(0, len(new), 20_000):
            part = new[s : s + 20_000]
            rows = self.kernel.of(part)
            broken = [i for i, w in enumerate(part) if not w.isalpha() and BROKEN.fullmatch(w)]
            if broken:
                rows[broken] = np.maximum(rows[broken], self.kernel.of([re.sub(r"\W|_", "", part[i]) for i in broken]))
            hit = np.flatnonzero(rows.any(axis=1))
            while self.n + len(hit) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.n : self.n + len(hit)] = rows[hit]
            number = np.zeros(len(part), np.int64)
            number[hit] = np.arange(self.n, self.n + len(hit))
            self.n += len(hit)
            self.index.update(zip(part, number.tolist(), strict=True))

    def sentence_kernels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(document, kernels): a row for every sentence that has a common subsequence with any landmark."""
        split = [with_spaced(t).replace("\n", " . ").replace("\r", " . ").split() for t in texts]
        self._learn(set().union(*split))
        get = self.index.__getitem__
        lengths = np.array([len(w) for w in split], np.int64)
        total = int(lengths.sum())
        ids = np.fromiter((i for w in split for i in map(get, w)), np.int64, total)
        ends = np.fromiter((x[-1] in ".!?" for w in split for x in w), bool, total)
        doc = np.repeat(np.arange(len(split)), lengths)
        sentence = np.cumsum(ends) - ends + doc
        hit = np.flatnonzero(ids)
        if not len(hit):
            return np.empty(0, np.int64), np.empty((0, self.rows.shape[1]))
        start = np.flatnonzero(np.r_[True, np.diff(sentence[hit]) > 0])
        return doc[hit][start], np.maximum.reduceat(self.rows[ids[hit]], start, axis=0)

    def margins(self, texts: list[str]) -> np.ndarray:
        m = self.model
        out = np.full(len(texts), m.bias)
        doc, kernels = self.sentence_kernels(texts)
        np.maximum.at(out, doc, kernels @ m.weights + m.bias)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.clip(self.model.slope * self.margins(texts) + self.model.offset, -700, 700)
        return 1 / (1 + np.exp(-z))


def training_words(text: str) -> set[str]:
    return {w.strip(SIGNS) for w in with_spaced(text).split()}


def choose_landmarks(counts: dict[str, tuple[int, int]], n_clean: int, n_toxic: int, most: int = LANDMARKS) -> list[str]:
    """Beginnings of words, or whole ones, that toxic documents have and others hardly: the most worth first, where a
    clean document counts as much as several toxic ones, the longest of equal worth, and one of each family of
    beginnings. counts has the (clean, toxic) documents with each beginning."""
    ratio = max(1.0, n_toxic / max(1, n_clean))
    worth = {s: toxic - 5 * ratio * clean for s, (clean, toxic) in counts.items()}
    chosen: list[str] = []
    for s in sorted(worth, key=lambda s: (-worth[s], -len(s), s)):
        if worth[s] < least_worth(n_toxic) or len(chosen) == most:
            break
        if not any(s.startswith(c) or c.startswith(s) for c in chosen):
            chosen.append(s)
    return chosen


def least_worth(n_toxic: int) -> float:
    return max(3.0, 0.02 * n_toxic)


def beginnings(words: set[str]) -> set[str]:
    return {w[:k] for w in words for k in range(ORDER, min(len(w), LONGEST) + 1)}


def gapped(counts: dict[str, int], marks: list[str]) -> tuple[list[str], list[float]]:
    """Words of toxic documents under each landmark, with one sign put in at every place of it, and their shares: a
    word weighs as many times as documents have it. Landmarks of ORDER characters have a single subsequence, which
    chance gives to clean words too: they get no room."""
    out, share = [], []
    for w, n in sorted(counts.items()):
        for m in (m for m in marks if len(m) > ORDER and w.startswith(m)):
            out += [w[:k] + "." + w[k:] for k in range(1, len(m))]
            share += [float(n)] * (len(m) - 1)
    return out, share


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, rounds: int = 100) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton's method on the rows within the margin."""
    one = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(one.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        inside = y * (one @ w) < 1
        a, s = one[inside], weight[inside] * c
        new = np.linalg.solve(ridge + (a * s[:, None]).T @ a, (a * s[:, None]).T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = 0.5 * (w + new) if _ > 20 else new
    return w[:-1], float(w[-1])


def calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the documents' margins, either label weighing half."""
    y = labels.astype(float)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 1e-3 * np.array([w[0], 0])
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        w = w - np.linalg.solve(hessian, gradient)
    return float(w[0]), float(w[1])


def nothing_learned() -> Model:
    return Model(["\2\2\2\2"], np.zeros(1), -1.0, 1.0, -10.0)


def nystrom(marks: list[str]) -> np.ndarray:
    """The inverse root of the landmarks' kernel matrix."""
    gram = Kernel(marks).of(marks)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T


def learn(marks: list[str], labels: np.ndarray, doc: np.ndarray, kernels: np.ndarray, gap_counts: dict[str, int], rounds: int = 4) -> Model:
    """A model from sentences: kernels[i] is one of document doc[i], whose label is labels[doc[i]]."""
    root = nystrom(marks)
    x = kernels @ root
    scale, margin = max(1.0, float(np.abs(x).max(initial=0))), kernels.max(axis=1, initial=0)
    gaps, share = gapped(gap_counts, marks)
    x, gaps = x / scale, Kernel(marks).of(gaps) @ root / scale
    share = GAPPED * np.array(share) / max(sum(share), 1.0)
    w, b = np.zeros(len(marks)), 0.0
    clean = np.flatnonzero(labels[doc] == 0)
    for _ in range(rounds):
        # the worst sentence of each toxic document; those without any common subsequence are left to the bias
        by = np.lexsort((margin, doc))
        last = by[np.r_[np.flatnonzero(np.diff(doc[by])), len(by) - 1]] if len(by) else by
        worst = last[labels[doc[last]] == 1]
        rows = np.r_[worst, clean]
        side = np.r_[np.ones(len(worst)), -np.ones(len(clean)), -1, np.ones(len(gaps))]
        weight = np.r_[np.full(len(worst), 2000 / max(len(worst), 1)), np.full(len(clean), 2000 / max(len(clean), 1)), 1000.0, share]
        w, b = squared_hinge(np.vstack([x[rows], np.zeros((1, len(marks))), gaps]), side, weight)
        margin = x @ w + b
    best = np.full(len(labels), b)
    np.maximum.at(best, doc, margin)
    return Model(marks, root @ w / scale, b, *calibrated(best, labels))


def train(texts: list[str], labels: list[int]) -> Model:
    """A model from labelled texts in memory; without toxic ones, clean ones, or anything that sets the toxic ones
    apart, it says 0 to all."""
    y = np.array(labels, int)
    words = [training_words(t) for t in texts]
    counts: dict[str, list[int]] = {}
    for own, label in zip(words, labels, strict=True):
        for s in beginnings(own):
            counts.setdefault(s, [0, 0])[label] += 1
    marks = choose_landmarks(counts, int((y == 0).sum()), int((y == 1).sum()))
    if not marks or not (y == 0).any():
        return nothing_learned()
    gap_counts = Counter(w for own, label in zip(words, labels, strict=True) if label for w in own if any(map(w.startswith, marks)))
    doc, kernels = Scorer(Model(marks, np.zeros(len(marks)), 0.0, 1.0, 0.0)).sentence_kernels(texts)
    return learn(marks, y, doc, kernels, gap_counts)


SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds == 0


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, chars: int) -> DataFrame:
    """(nr, label, t): labelled documents outside the held-out fold, at most `most` of either label (and 4 times as many
    texts, where ids repeat with others), the first by a hash of the id, and no further one once those before it hold `chars` characters. Texts are whole; copies of one
    count once, as toxic if one of them is."""
    told = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    told = told.groupBy(F.col(id_col).alias("id")).agg((F.max(F.col(label_col).cast("int")) > 0).cast("int").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = told.where("label = 1").orderBy(*order).limit(most).unionByName(told.where("label = 0").orderBy(*order).limit(most))
    # 2 * most ids of 12 bytes: a fixed bound
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), "id")
    rows = materialize(rows, "labelled")
    # at most 2 * most rows without their texts, and those that repeat their ids; copies of a text are one document
    own = rows.withColumn("h", F.xxhash64("t"))
    sizes = own.groupBy("h").agg(F.max("label").alias("label"), F.min(F.struct(F.xxhash64("id").alias("o"), "id")).alias("one"), F.max(F.length("t")).alias("n"))
    sizes = sizes.select("h", "label", "one.id", "one.o", "n")
    # ids are `most` for each label, but one may stand at any number of texts: a fixed number of texts is put in order
    first = [sizes.where(f"label = {k}").orderBy("o", "id", "h").limit(4 * most) for k in (0, 1)]
    sizes = first[0].unionByName(first[1])
    by = Window.partitionBy("label").orderBy("o", "id", "h")
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = sizes.where(F.col("before") < chars).withColumn("nr", F.row_number().over(Window.orderBy("label", "o", "id", "h")) - 1)
    kept = own.select("id", "h", "t").dropDuplicates(["id", "h"]).join(sizes.select("id", "h", "label", "nr"), ["id", "h"])
    out = materialize(kept.select("nr", "label", "t").repartition(docs.sparkSession.sparkContext.defaultParallelism, "nr"), "sample")
    release(docs.sparkSession, rows)
    return out


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = DOCS, chars: int = CHARS
) -> Model:
    """Train on a bounded sample of labelled documents, all sentences of their whole texts.

    At most `most` documents of either label are used, and of them no further one once those before it in the order of
    their ids' hashes hold `chars` characters; both bounds are for training alone. Words are counted and kernels
    computed by executors; the driver gets the sentences' kernels with the landmarks, 32 numbers each, equal ones of a
    document once. A document with several labels is toxic if one says so; null labels and ids and labels without a
    document are left out, and so are held-out ids. Texts that differ under one id are documents of their own.
    Columns of other names are not read. Empty tables: a model that says 0 to all.
    """
    sample = training_sample(docs, labels, id_col, text_col, label_col, most, chars)
    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = n.get(0, 0), n.get(1, 0)
    if not n_clean or not n_toxic:
        return nothing_learned()

    def count(own):
        """(s, clean, toxic): documents of a task with a beginning, or of toxic ones alone with a word."""

        def run(batches):
            counts: dict[str, list[int]] = {}
            for batch in batches:
                for label, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    for s in own(training_words(t), label):
                        counts.setdefault(s, [0, 0])[label] += 1
            cols = [list(counts), [c for c, _ in counts.values()], [c for _, c in counts.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["s", "clean", "toxic"])

        return sample.mapInArrow(run, "s string, clean long, toxic long").groupBy("s").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    worth = F.col("toxic") - 5 * max(1.0, n_toxic / n_clean) * F.col("clean")
    # at most the toxic documents' beginnings over 2 percent of their number
    counts = {r.s: (r.clean, r.toxic) for r in count(lambda words, _: beginnings(words)).where(worth >= least_worth(n_toxic)).collect()}
    marks = choose_landmarks(counts, n_clean, n_toxic)
    if not marks:
        return nothing_learned()
    under = count(lambda words, label: [w for w in words if label and any(map(w.startswith, marks))])
    gap_counts = {r.s: r.toxic for r in under.collect()}
    blank = Model(marks, np.zeros(len(marks)), 0.0, 1.0, 0.0)

    def sentences(batches):
        scorer = blank.scorer()
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                doc, kernels = scorer.sentence_kernels(part.column(2).to_pylist())
                each = np.unique(np.hstack([doc[:, None], kernels]), axis=0)
                nr = part.column(0).take(pa.array(each[:, 0].astype(np.int64)))
                ends = pa.array(np.arange(len(each) + 1, dtype=np.int32) * len(marks))
                yield pa.RecordBatch.from_arrays([nr, pa.ListArray.from_arrays(ends, pa.array(each[:, 1:].ravel()))], names=["nr", "k"])

    told = {r.nr: r.label for r in sample.select("nr", "label").collect()}
    labels_of = np.array([told[k] for k in range(len(told))], int)
    got = sample.mapInArrow(sentences, "nr int, k array<double>").toArrow()
    doc = got.column("nr").to_numpy()
    kernels = got.column("k").combine_chunks().flatten().to_numpy().reshape(len(doc), len(marks)) if len(doc) else np.empty((0, len(marks)))
    order = np.lexsort((*kernels.T[::-1], doc))
    release(docs.sparkSession, sample)
    return learn(marks, labels_of, doc[order], kernels[order], gap_counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text: predicted is 1 from a score of 0.5.

    Nulls: a null text is an empty one, whose score is that of a text without any likeness; a null id is kept. Rows
    with equal texts get equal scores. Words of any length are matched whole. Empty table: no rows. Other columns are
    not read.
    """

    def run(batches):
        scorer = model.scorer()
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                p = scorer.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose whole text scores under 0.5, as they are; null and empty texts stay.

    Repeated rows stay or go together. Empty table: no rows. Columns of docs may have any names.
    """

    def run(batches):
        scorer = model.scorer()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                p = scorer.scores([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)
