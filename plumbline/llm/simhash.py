"""SimHash near-duplicates by covering locality-sensitive hashing.

A radius r and a map m of the fingerprint's bits to nonzero vectors of r + 1 bits give 2^(r+1) - 1 masks: mask v keeps
the bits i with <m(i), v> = 1 (mod 2). Any r differing bits satisfy r equations <m(i), v> = 0 in the r + 1 unknowns of
v, so that some nonzero v leaves all of them out: every pair within the radius agrees under some mask, and no chance
is involved. A mask keeps about half of the bits.

Buckets with more fingerprints than a task should compare are masked again on the bits that are still free, up to the
level at which so few bits are free that a bucket's size is bounded by two to that power. So a dense group costs a
fixed number of rows for each of its fingerprints and no bucket is ever compared beyond the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.components import connected_components
from plumbline.runtime import materialize, release

BITS = 64
SEED = 42
#: Fingerprints that one bucket may hold for all of its pairs to be compared.
BUCKET = 1024


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of all shingles of a text; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(g, seed) for g in grams], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int32)
    set_bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = SEED) -> DataFrame:
    """(id, fp): the signed 64-bit form of every text's fingerprint. A null text has no words, so fp 0."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def covering_masks(free: int, radius: int, salt: int = 0) -> list[int]:
    """The 2^(radius+1) - 1 masks over the set bits of free, which keep each the bits whose vector has parity 1."""
    vectors = (1 << (radius + 1)) - 1
    places = [i for i in range(BITS) if free >> i & 1]
    # the bits' vectors: all nonzero ones in turn, dealt in an order that depends on the salt
    order = sorted(range(len(places)), key=lambda k: xxhash.xxh64_intdigest(f"{salt}:{places[k]}", 7))
    vector = {places[k]: 1 + j % vectors for j, k in enumerate(order)}
    return [sum(1 << i for i in places if (vector[i] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask_tree(radius: int, levels: int) -> list[list[tuple[int, int]]]:
    """For each level the list of (parent's number, mask of all bits kept so far)."""
    full = (1 << BITS) - 1
    tree = [[(0, m) for m in covering_masks(full, radius)]]
    for level in range(1, levels):
        tree.append([(k, kept | m) for k, (_, kept) in enumerate(tree[-1]) for m in covering_masks(full & ~kept, radius, level)])
    return tree


def _rows(fps: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """Each fingerprint under each mask: (t, key, fp)."""
    kept = F.array(*[F.lit(_signed(m)) for _, m in masks])
    return fps.select("fp", F.posexplode(kept).alias("t", "m")).select("t", F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp")


def _close_in_buckets(rows: DataFrame, radius: int) -> DataFrame:
    """Edges between fingerprints of the same bucket within the radius: for each bucket a spanning forest of them.

    The rows of one bucket, BUCKET at most, come together and sorted; buckets are held one at a time.
    """

    def forest(fps: np.ndarray):
        parent = list(range(len(fps)))

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in range(len(fps) - 1):
            near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius)
            for j in near + i + 1:
                a, b = find(i), find(int(j))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    yield fps[i], fps[j]

    def run(batches):
        rest = None
        for batch in _with_end(batches):
            if batch is None:
                t, key, fp = rest if rest is not None else (np.empty(0), np.empty(0), np.empty(0, np.uint64))
                cut = len(t)
            else:
                t, key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                fp = fp.view(np.uint64)
                if rest is not None:
                    t, key, fp = (np.concatenate(x) for x in zip(rest, (t, key, fp), strict=True))
                new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
                cut = new[-1] if len(new) else 0
            rest = (t[cut:], key[cut:], fp[cut:])
            starts = np.r_[0, np.flatnonzero((t[1:cut] != t[: cut - 1]) | (key[1:cut] != key[: cut - 1])) + 1, cut] if cut else [0]
            out = [e for a, b in zip(starts[:-1], starts[1:], strict=True) if b - a > 1 for e in forest(fp[a:b])]
            if out:
                pairs = np.array(out, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    dealt = rows.repartition("t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(run, "a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def near_pairs(fps: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of fps (column fp, distinct) whose components are those of all
    pairs within the radius. No pair within the radius lies in two components."""
    tree = mask_tree(radius, 3)
    free = max(BITS - m.bit_count() for _, m in tree[-1])
    found, live, parents = [], None, None
    for level, masks in enumerate(tree):
        if level == 0:
            rows = _rows(fps, masks)
        else:
            # the masks of the buckets that were too large, refined
            child = {}
            for k, (parent, m) in enumerate(masks):
                child.setdefault(parent, []).append((k, m))
            finer = F.array(
                *[F.array(*[F.struct(F.lit(k).alias("t"), F.lit(_signed(m)).alias("m")) for k, m in child[p]]) for p in range(len(parents))]
            )
            rows = live.select("fp", F.explode(F.element_at(finer, F.col("t") + 1)).alias("x")).select(
                F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp"
            )
        limit = bucket if level + 1 < len(tree) else max(bucket, 1 << free)
        # counts are written before they are joined: then both sides are plain shuffles, whose hot buckets can be split
        sizes = materialize(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), f"sizes{level}")
        rows = materialize(rows.join(sizes, ["t", "key"]), f"buckets{level}")
        found.append(_close_in_buckets(rows.where(F.col("n") <= limit).select("t", "key", "fp"), radius))
        live, parents = rows.where(F.col("n") > limit).select("t", "key", "fp"), masks
        if level + 1 == len(tree) or live.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, seed: int = SEED
) -> DataFrame:
    """One row per document: (id, fingerprint, component_id), the component of all links within the radius.

    component_id is the smallest id of the component. Texts with equal fingerprints meet in one class before any
    comparison, so that copies cost nothing. Nulls: a null text has no words and fingerprint zero, linked like any
    other; a null id keeps its row and takes no part in the smallest id (a component of null ids alone has none).
    Repeated ids give a row each. Empty table: no rows. Other columns are not read.
    """
    fp = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fp")
    classes = materialize(fp.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    edges = near_pairs(classes.select("fp"), radius)
    comps = connected_components(edges, "a", "b")
    of_class = classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    of_class = materialize(of_class, "class-components")
    smallest = materialize(of_class.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    of_class = materialize(of_class.join(smallest, "component").select("fp", "component_id"), "class-ids")
    release(docs.sparkSession, smallest)
    return fp.join(of_class, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with the others gone; rows with a null id stay.

    A null text has fingerprint zero like a text without words, and is linked like any other. Rows that share an id
    go together if one of them has a smaller id in its component. Empty table: no rows. Columns of docs may have any
    names.
    """
    found = simhash_components(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "id", "t")
    gone = materialize(found.where(F.col("id") > F.col("component_id")).select(F.col("id").alias(id_col)).distinct(), "copies")
    return docs.join(gone, docs[id_col] == gone[id_col], "left_anti")
