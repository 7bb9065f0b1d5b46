"""Exact top-k search by inner product: tiles of a query block and a shard, partial selection, tree merging.

Shards and query blocks are matrices in files of the shared store. Only their names move: the grid of all tiles is
dealt out as names, and a task reads a shard once for a tile row of several blocks. Each task's lists are merged FAN
shards at a time, round after round, until one list is left of each query.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from plumbline.runtime import materialize, scratch_path
from plumbline.sources.store import open_input, open_output

#: Rows of a shard, queries of a block, and candidates that one product takes at a time.
SHARD, BLOCK, STRIP = 16384, 1024, 4096
#: Blocks of one tile row, groups that the grid's names are dealt out in, and tasks that work on tile rows at most.
ROW, GROUPS, TASKS = 16, 64, 20_000
#: Shards whose lists meet in one merge.
FAN = 16
MATRIX = "path string, dim int, n int"


def quantized(vec: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double; null if the vector, or any component, is null or not finite."""
    x = lambda v: v.cast("double")
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    return F.when(vec.isNotNull() & ~bad, F.transform(vec, lambda v: F.floor(F.lit(scale) * x(v)).cast("long")))


def _packed(rows: DataFrame, size: int, folder: str) -> DataFrame:
    """Rows (id, q) as matrix files of size rows at most, written where the rows lie: MATRIX, a row for each file. The
    vectors of a file have one length; its ids ascend. A file's name belongs to the task's attempt."""

    def emit(dim, ids, vectors):
        ids = np.concatenate(ids)
        order = np.argsort(ids, kind="stable")
        path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.mat"
        with open_output(path) as out:
            out.write(ids[order].astype("<i8").tobytes())
            out.write(np.concatenate(vectors).reshape(len(ids), dim)[order].astype("<i8").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32())], names=["path", "dim", "n"])

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(lengths)]
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                have = held.setdefault(int(dim), [[], [], 0])
                for k in range(0, len(own), size):
                    pick = own[k : k + size]
                    if have[2] + len(pick) > size and have[2]:
                        yield emit(int(dim), *have[:2])
                        have[:] = [[], [], 0]
                    have[0].append(ids[pick])
                    have[1].append(flat[(at[pick][:, None] + np.arange(dim)).ravel()] if dim else np.empty(0, np.int64))
                    have[2] += len(pick)
        for dim, have in held.items():
            if have[2]:
                yield emit(dim, *have[:2])

    return materialize(rows.mapInArrow(run, MATRIX), "matrices")


def _matrix(path: str, dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a matrix file."""
    with open_input(path) as file:
        data = file.read()
    return np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n * dim, 8 * n).reshape(n, dim)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where no sum can reach 2^53, else in Python's integers."""
    most = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0))
    if most(q) * most(c) * max(q.shape[1], 1) < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    wide = q.astype(object) @ c.astype(object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def tile_top(q_ids, q, c_ids, c, k: int):
    """The k best candidates of each query in one tile: (query id, score, id) arrays. c_ids ascend, so that ties at the
    border go to the smaller ids."""
    scores = _products(q, c)
    own = q_ids[:, None] == c_ids[None, :]
    lowest = np.iinfo(np.int64).min
    scores = np.where(own, lowest, scores)
    kth = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(q), lowest)
    row, col = np.nonzero((scores >= kth[:, None]) & ~own)
    best = scores[row, col]
    order = np.lexsort((col, -np.maximum(best, lowest + 1), row))
    row, col, best = row[order], col[order], best[order]
    start = np.r_[0, np.flatnonzero(np.diff(row)) + 1] if len(row) else np.empty(0, int)
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    keep = rank < k
    return q_ids[row[keep]], best[keep], c_ids[col[keep]]


def merged(q_ids, scores, ids, k: int):
    """The k best of each query's candidates, ties to the smaller id."""
    order = np.lexsort((ids, -np.maximum(scores, np.iinfo(np.int64).min + 1), q_ids))
    q_ids, scores, ids = q_ids[order], scores[order], ids[order]
    start = np.flatnonzero(np.r_[True, q_ids[1:] != q_ids[:-1]]) if len(q_ids) else np.empty(0, int)
    keep = np.arange(len(q_ids)) - np.repeat(start, np.diff(np.r_[start, len(q_ids)])) < k
    return q_ids[keep], scores[keep], ids[keep]


def exact_top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """The k best rows for every row where queries holds: (query_id, rank from 1, id, score), ties to the smaller id.

    All rows but those with the query's own id are candidates. Shards are packed where the rows lie; a tile row is a
    shard with ROW query blocks at most, for which a task reads the shard once and one block after the other; of each
    product at most k candidates a query go on; lists are merged FAN shards at a time. Nothing is broadcast by hint,
    and a task holds a shard, a block and the product of a strip at a time.

    Nulls: a vector that is null or holds a null, NaN or infinite component takes no part, nor does a null id. Vectors
    of different lengths don't meet. Candidates that repeat as rows repeat in the result; a repeated query counts once
    (with several vectors under one id, their lists are merged). Scores beyond 64 bits are held at the border. Empty
    table: no rows. Other columns are not read. Ids are whole numbers; any other type is a ValueError.
    """
    if not isinstance(vectors.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must hold whole numbers")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vec_col), scale).alias("q"), queries.alias("asks"))
    rows = rows.where("q IS NOT NULL")
    folder = scratch_path(vectors.sparkSession, "top-k")
    shards = _packed(rows.select("id", "q"), SHARD, f"{folder}/shards")
    asks = rows.where("asks").select("id", "q").distinct()
    n_asks = asks.count()
    blocks = _packed(asks.repartition(max(1, -(-n_asks // BLOCK)), "id"), BLOCK, f"{folder}/blocks")

    # names only: lists of ROW blocks at most meet the shards of the same vector length, in GROUPS groups for each length
    place = F.xxhash64("path")
    by_dim = Window.partitionBy("dim").orderBy("path")
    lists = blocks.withColumn("row", F.floor((F.row_number().over(by_dim) - 1) / ROW)).groupBy("dim", "row").agg(F.collect_list(F.struct("path", "n")).alias("blocks"))
    lists = lists.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
    names = shards.withColumn("g", F.pmod(place, F.lit(GROUPS)).cast("int"))
    grid = materialize(names.join(lists, ["dim", "g"]).select("path", "dim", "n", "blocks"), "grid")
    n_shards = max(1, shards.count())
    spread = grid.repartition(max(1, min(TASKS, grid.count())), "path", "blocks")

    def run(batches):
        for batch in batches:
            for path, dim, n, own in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3).to_pylist(), strict=True):
                ids, c = _matrix(path, dim, n)
                group = xxhash.xxh64_intdigest(path) % n_shards
                for block in own:
                    q_ids, q = _matrix(block["path"], dim, block["n"])
                    found = [tile_top(q_ids, q, ids[s : s + STRIP], c[s : s + STRIP], k) for s in range(0, n, STRIP)]
                    a, v, b = merged(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(v), pa.array(b), pa.array(np.full(len(a), group, np.int64))], names=["query_id", "score", "id", "g"])

    lists = spread.mapInArrow(run, "query_id long, score long, id long, g long")
    best = [F.col("score").desc(), F.col("id")]
    groups = n_shards
    while groups > 1:
        groups = -(-groups // FAN)
        lists = lists.withColumn("g", F.pmod(F.col("g"), F.lit(groups)))
        lists = lists.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "g").orderBy(*best))).where(F.col("r") <= k).drop("r")
    last = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)))
    return last.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
