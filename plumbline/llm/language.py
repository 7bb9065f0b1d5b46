"""Language identification: averaged embeddings of hashed subwords with a linear softmax, trained by gradient descent in numpy.

A text is the mean of the vectors of its subwords, the runs of 2 to 4 characters within its words and their borders.
Since everything behind the vectors is linear, scoring adds up for each language one number per subword.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.runtime import free_name, materialize, release

#: Vectors of subwords and their length; characters of the longest subword.
BUCKETS, DIM, LONGEST = 1 << 16, 16, 4
#: Bounds of the training sample: documents of a language, characters of all together, languages (the most frequent).
DOCS, CHARS, LANGS = 1000, 2 << 20, 500
#: Words of a training example, passes over the examples, examples of a step, step sizes of the head and of the vectors.
WORDS, PASSES, STEP, RATE, VECTOR_RATE = 12, 6, 32, 0.5, 10.0
#: The length that a step moves a vector, or a language's part of the head, at most.
FAR = 0.1
#: Accuracy that accepted texts of the calibration fold have.
ACCURACY = 0.99
#: Characters that are hashed together, cut at ends of words.
STRIP = 1 << 18
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def strips(text: str):
    """The text in pieces of about STRIP characters that end behind a character that is in no word."""
    begin = 0
    while len(text) - begin > STRIP:
        end = re.compile(r"\W").search(text, begin + STRIP)
        if not end:
            break
        yield text[begin : end.end()]
        begin = end.end()
    yield text[begin:]


def subwords(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of lower-case texts, and the text of each. Runs of what is no letter are a word's border."""
    marked = ["\0" + t + "\0" for t in texts]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[c], c, np.uint32(0))
    of = np.repeat(np.arange(len(texts)), sizes)
    begins = np.zeros(len(c), bool)
    begins[np.cumsum(sizes) - sizes] = True
    kept = (c != 0) | np.r_[False, c[:-1] != 0] | begins
    c, of = c[kept], of[kept]
    inner = c != 0
    h, whole, ids, owners = c * np.uint32(0x9E3779B1), np.ones(len(c), bool), [], []
    for n in range(2, LONGEST + 1):
        last = len(c) - n + 1
        if last <= 0:
            break
        h = (h[:last] ^ (h[:last] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        if n == 2:
            good = inner[:last] | inner[1:]
        else:
            whole = whole[:last] & inner[n - 2 : n - 2 + last]
            good = whole
        mixed = h[good]
        mixed = (mixed ^ (mixed >> np.uint32(16))) * np.uint32(0xC2B2AE35)
        ids.append(((mixed ^ (mixed >> np.uint32(13))) % np.uint32(buckets)).astype(np.int32))
        owners.append(of[:last][good])
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    # texts do not meet within a subword: between two stand two borders
    return ids, owners


@dataclass
class Model:
    """vectors times head are a text's values for langs, at a temperature; texts of a score under `least` are rejected."""

    langs: list[str]
    vectors: np.ndarray
    head: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """The table whose rows are added up, and what its sums are multiplied by: the smaller way of two."""
        if len(self.langs) <= self.vectors.shape[1]:
            return np.ascontiguousarray((self.vectors @ self.head).T), np.eye(len(self.langs), dtype=np.float32)
        return np.ascontiguousarray(self.vectors.T), self.head

    def values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Values for each language before the temperature, and the number of subwords, of whole texts."""
        table, head = self.folded()
        return values(table, head, texts)


def values(table: np.ndarray, head: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sums, counts = np.zeros((len(texts), len(table))), np.zeros(len(texts), np.int64)
    batch, owner, held = [], [], 0

    def add() -> None:
        ids, of = subwords(batch, table.shape[1])
        of = np.array(owner)[of]
        counts[:] += np.bincount(of, minlength=len(texts))
        for k, row in enumerate(table):
            sums[:, k] += np.bincount(of, row[ids], len(texts))

    for i, t in enumerate(texts):
        for piece in strips(t.lower()):
            batch.append(piece)
            owner.append(i)
            held += len(piece)
            if held >= STRIP:
                add()
                batch, owner, held = [], [], 0
    if batch:
        add()
    return sums / np.maximum(counts, 1)[:, None] @ head, counts


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def examples(texts: list[str], labels: list[int]) -> tuple[list[str], np.ndarray]:
    """Stretches of WORDS words that make up the whole texts, with letters in them."""
    out, of = [], []
    for t, label in zip(texts, labels, strict=True):
        words = t.lower().split()
        for i in range(0, len(words), WORDS):
            piece = " ".join(words[i : i + WORDS])
            if any(map(str.isalpha, piece)):
                out.append(piece)
                of.append(label)
    return out, np.array(of, np.int64)


def _short(step: np.ndarray, axis: int) -> np.ndarray:
    """The step with no vector along the axis longer than FAR, so that labels which contradict each other cannot blow it up."""
    size = np.sqrt((step * step).sum(axis=axis, keepdims=True))
    return (step * np.minimum(1, FAR / np.maximum(size, 1e-12))).astype(np.float32)


def train(texts: list[str], labels: list[int], langs: list[str], seed: int = 42) -> Model:
    """Vectors and head by stochastic gradient descent on the examples of whole texts. Languages weigh alike."""
    rnd = np.random.default_rng(seed)
    vectors = rnd.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    head = np.zeros((DIM, len(langs)), np.float32)
    pieces, y = examples(texts, labels)
    if not pieces:
        return Model(langs, vectors, head)
    ids, of = subwords(pieces)
    by = np.argsort(of, kind="stable")
    ids, sizes = ids[by], np.bincount(of, minlength=len(pieces))
    starts = np.cumsum(sizes) - sizes
    share = np.bincount(y, minlength=len(langs)).astype(np.float64)
    weight = (len(y) / (np.count_nonzero(share) * np.maximum(share, 1)))[y].clip(0.1, 10)
    steps = PASSES * -(-len(pieces) // STEP)
    done = 0
    for _ in range(PASSES):
        order = rnd.permutation(len(pieces))
        for s in range(0, len(order), STEP):
            own = order[s : s + STEP]
            n = sizes[own]
            first = np.cumsum(n) - n
            part = ids[np.repeat(starts[own] - first, n) + np.arange(n.sum())]
            mean = np.add.reduceat(vectors[part], first, axis=0) / n[:, None]
            wrong = softmax(mean @ head)
            wrong[np.arange(len(own)), y[own]] -= 1
            wrong *= weight[own][:, None]
            left = 1 - done / steps
            back = (wrong @ head.T) / n[:, None]
            head -= left * _short(RATE * mean.T @ wrong, 0)
            # gradients of a vector that comes more than once are added up before they are taken off
            by = np.argsort(part, kind="stable")
            same = np.flatnonzero(np.r_[True, np.diff(part[by]) != 0])
            moved = np.add.reduceat(np.repeat(back, n, axis=0)[by], same, axis=0)
            vectors[part[by][same]] -= left * _short(VECTOR_RATE * moved, 1)
            done += 1
    return Model(langs, vectors, head)


def calibrated(model: Model, texts: list[str], labels: list[int]) -> Model:
    """The model with a temperature that makes scores probabilities on texts it was not trained on and their stretches,
    and with the least score from which these are right as often as ACCURACY says."""
    pieces, y = examples(texts, labels)
    held = [(t, k) for t, k in zip(texts, labels, strict=True) if any(map(str.isalpha, t))]
    y = np.r_[y, [k for _, k in held]].astype(np.int64)
    if not len(y):
        return model
    x, _ = model.values(pieces + [t for t, _ in held])

    def loss(temperature: float) -> float:
        return float(-np.log(np.maximum(softmax(x / temperature)[np.arange(len(y)), y], 1e-12)).mean())

    temperature = min(np.geomspace(0.1, 10, 41), key=loss)
    p = softmax(x / temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    by = np.argsort(-score, kind="stable")
    kept = np.cumsum(right[by]) / np.arange(1, len(y) + 1) >= ACCURACY
    last = np.flatnonzero(kept)
    least = float(score[by][last[-1]]) if len(last) else 1.0
    return Model(model.langs, model.vectors, model.head, float(temperature), least)


def fold(id_col: Column, folds: int = 4) -> Column:
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held_out: int, most: int, chars: int) -> DataFrame:
    """(lang, calibrates, h, t): documents with a language outside the held-out fold.

    Of each language at most `most` documents, in the order of a hash of the text, and of them those that together hold
    no more than its share of `chars` characters; copies of a text count once. Counts of the languages come first, so
    that only a little more than what is needed is put in order.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), fold(F.col(id_col)).alias("f"), F.col(text_col).alias("t"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("t").isNotNull() & (F.col("f") != held_out))
    rows = rows.select("id", "lang", (F.col("f") == (held_out + 1) % 4).alias("calibrates"), F.xxhash64("t").alias("h"), F.length("t").alias("n"), "t")
    # LANGS rows at most
    counts = rows.groupBy("lang").agg(F.count("*").alias("all")).orderBy(F.col("all").desc(), "lang").limit(LANGS)
    counts = materialize(counts, "languages")
    each = chars // max(1, counts.count())
    place = F.xxhash64("h", F.lit(42)).bitwiseAND(F.lit((1 << 31) - 1))
    near = rows.drop("t").join(F.broadcast(counts), "lang").withColumn("u", place).where(F.col("u") < F.lit(float(1 << 31)) * 8 * most / F.col("all"))
    one = near.groupBy("h", "u").agg(F.min(F.struct("calibrates", "lang", "id", "n")).alias("x")).select("h", "u", "x.*").where(F.col("n") <= each)
    by = Window.partitionBy("lang").orderBy("u", "h")
    one = one.withColumn("nr", F.row_number().over(by)).where(F.col("nr") <= most).withColumn("upto", F.sum("n").over(by)).where(F.col("upto") <= each)
    # no more rows than `chars`, `most` for each language
    chosen = F.broadcast(materialize(one.select("h", "id", "lang", "calibrates"), "chosen").withColumnRenamed("id", "i"))
    texts = rows.select("h", "id", "t").join(chosen, "h").where(F.col("id").eqNullSafe(F.col("i"))).dropDuplicates(["h"])
    out = materialize(texts.select("lang", "calibrates", "h", "t"), "sample")
    release(spark, counts)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2, most: int = DOCS, chars: int = CHARS) -> Model | None:
    """Train on a bounded sample of the documents whose crc32 of the id, modulo 4, is not held_out.

    The sample has `most` documents of a language and `chars` characters at most, whole texts; these bounds are for
    training alone, and what the driver holds does not grow with docs. The fold behind the held-out one, of which the
    sample has its part, is for the temperature and the least score; the others are for the vectors.

    Null texts, languages and ids without a language are left out; a null id hashes as an empty string. A text that has
    several languages counts for the first. Without any document with a language: None. Other columns are not read.
    """
    sample = training_sample(docs, id_col, text_col, lang_col, held_out, most, chars)
    got = sorted((r.lang, r.calibrates, r.h, r.t) for r in sample.collect())
    release(docs.sparkSession, sample)
    langs = sorted({lang for lang, *_ in got})
    if not langs:
        return None
    nr = {lang: k for k, lang in enumerate(langs)}
    taught = [(t, nr[lang]) for lang, calibrates, _, t in got if not calibrates] or [(t, nr[lang]) for lang, _, _, t in got]
    tested = [(t, nr[lang]) for lang, calibrates, _, t in got if calibrates]
    return calibrated(train([t for t, _ in taught], [k for _, k in taught], langs), [t for t, _ in tested], [k for _, k in tested])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) of every whole text.

    score is the probability that the model gives the language it names; accepted says whether it reaches the least
    score, from which the calibration fold's texts were right as often as ACCURACY says. A rejected text keeps its
    likeliest language.

    Null texts and texts without a letter are `und` with score 0 and not accepted, and so are all texts without a model.
    A null id is kept. Equal texts get equal results. Texts of any length are whole, read in strips. Empty table: no
    rows. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = free_name([id_col], "t")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias(own))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    # BUCKETS rows of DIM numbers at most
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, *model.folded(), model.temperature, model.least))

    def run(batches):
        langs, table, head, temperature, least = shared.value
        names = np.array([*langs, UNKNOWN], object)
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                x, n = values(table, head, part.column(1).to_pylist())
                p = softmax(x / temperature)
                score = np.where(n > 0, p.max(axis=1), 0.0)
                best = np.where(n > 0, p.argmax(axis=1), len(langs))
                cols = [part.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array((n > 0) & (score >= least))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "lang_pred", "score", "accepted"])

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("id", id_col)
