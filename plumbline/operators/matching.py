"""Matching of records between two sides: by unique keys, pass after pass, by preferences, and as many as possible."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import lines
from plumbline.runtime import SHARE, materialize, release


def match_cascade(before: DataFrame, after: DataFrame, passes: list[tuple[str, list[str]]], id_col: str = "id") -> DataFrame:
    """(before_id, after_id, method): pairs whose key is unique on both sides, the first pass that says so.

    A key's uniqueness is counted on the sides as they came, not on what earlier passes left, so that ambiguity never
    picks a winner. A key that holds a null matches nothing. Each pass is two counts with map-side combination, a join
    of unique keys, and two anti joins against what is matched.
    """
    out = None
    for method, keys in passes:
        sides = []
        for df, name in ((before, "before_id"), (after, "after_id")):
            one = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n"), F.min(id_col).alias(name)).where("_n = 1").drop("_n")
            sides.append(one)
        found = sides[0].join(sides[1], keys).select("before_id", "after_id", F.lit(method).alias("method"))
        if out is None:
            out = found
        else:
            found = found.join(out.select("before_id"), "before_id", "left_anti").join(out.select("after_id"), "after_id", "left_anti")
            out = out.unionByName(found.select("before_id", "after_id", "method"))
    return out


def stable_pairs(pairs: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The rows of pairs (stratum, left_id, right_id, ...) that are the one stable one-to-one choice: no left and right row
    that form a pair would both rather have each other.

    A left row prefers pairs by left_order, then right_id, a right row by right_order, then left_id. In each round every
    left row asks for the best pair that it still has, a right row holds the best that asks, and what is worse for it than
    the one it holds goes; once none is turned away, those held are the result. So the choice is that of going through
    the pairs one after the other: by one order for both sides, greedily, or left rows in their order, each with the best
    right row left. Rounds are aggregations with partial sums before the exchange, and joins on what is left, so that
    no group of a stratum, or of a row with very many pairs, is ever one task's. More than SHARE pairs are dealt in shares
    of so many before they are grouped, since a task of files has many millions of them to sort.

    Null ids take no part. Pairs that repeat count once, the best of them. Empty table: no rows.
    """
    spark = pairs.sparkSession
    left = F.struct(*left_order, "right_id")
    right = F.struct(*right_order, "left_id")
    live = materialize(pairs.dropna(subset=["left_id", "right_id"]), "pairs")
    while True:
        whole = F.struct(*[c for c in live.columns if c not in ("stratum", "left_id")])
        tasks = -(-live.count() // SHARE)
        shares = live.repartition(max(tasks, spark.sparkContext.defaultParallelism), "left_id", "right_id") if tasks > 1 else live
        asks = shares.groupBy("stratum", "left_id").agg(F.min_by(whole, left).alias("pair"))
        asks = materialize(asks.select("stratum", "left_id", "pair.*").select(*live.columns), "asks")
        whole = F.struct(*[c for c in live.columns if c not in ("stratum", "right_id")])
        held = materialize(asks.groupBy("stratum", "right_id").agg(F.min_by(whole, right).alias("held"), F.count("*").alias("asked")), "held")
        if held.where("asked > 1").isEmpty():
            release(spark, live, held)
            return asks
        mine = held.select(F.col("stratum").alias("_s"), F.col("right_id").alias("_r"), F.struct(*[F.col(f"held.{c}") for c in (*right_order, "left_id")]).alias("_held"))
        better = live.join(mine, F.col("stratum").eqNullSafe(F.col("_s")) & (F.col("right_id") == F.col("_r")), "left")
        rest = materialize(better.where(F.col("_held").isNull() | (right <= F.col("_held"))).select(*live.columns), "pairs")
        release(spark, live, asks, held)
        live = rest


def _repeats(df: DataFrame, *key: str) -> bool:
    return not df.groupBy(*key).count().where("count > 1").isEmpty()


def _plain(df: DataFrame, *names: str) -> bool:
    """Whether Arrow orders these columns as Spark does."""
    return all(isinstance(t, (T.IntegralType, T.DecimalType, T.DateType, T.TimestampType)) or t == T.StringType() for t in (df.schema[c].dataType for c in names))


#: Rows of both sides that greedy_match gives to one piece of the line of values, about.
PIECE = 1 << 17


def _closest(code: np.ndarray, value: np.ndarray, side: np.ndarray, rank: np.ndarray, cut: bool, caliper: float) -> tuple[list[int], list[int], list[int]]:
    """Positions of the left and the right rows of greedy pairs, and of rows that can't be told here.

    Rows are sorted by stratum, value, side (0 left, 1 right) and rank of the id; rows of one value are a node. The closest
    free pair is always of two nodes side by side, so that only those are in the heap, and a pair made makes new neighbours.
    If cut, the first and the last stratum may go on elsewhere. What lies there is a region with a front for either side:
    a row that is no further from the other side's front than the pairs that come next may find its partner there. It
    is left over, and its value is the front of its side, since it may be another's partner or not.
    """
    begins = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (value[1:] != value[:-1]) | (side[1:] != side[:-1])])
    v, k, of, at, end, rank = value[begins].tolist(), side[begins].tolist(), code[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(code)], rank.tolist()
    n = len(v)
    before = [i - 1 if i and of[i] == of[i - 1] else -1 for i in range(n)] + [-1, -1]
    after = [i + 1 if i + 1 < n and of[i] == of[i + 1] else -1 for i in range(n)] + [-1, -1]
    if cut:
        before[0], after[n], after[n - 1], before[n + 1] = n, 0, n + 1, n - 1
    front, dead, heap = {n: [v[0]] * 2, n + 1: [v[-1]] * 2}, [False] * (n + 2), []
    lefts, rights, over = [], [], []

    def meet(i: int, j: int) -> None:
        if i < 0 or j < 0 or (i >= n and j >= n):
            return
        if i >= n or j >= n:
            region, w = (i, j) if i >= n else (j, i)
            entry = (abs(v[w] - front[region][1 - k[w]]), -1, -1, region, w)
        elif k[i] != k[j]:
            x, y = (i, j) if k[j] else (j, i)
            entry = (abs(v[x] - v[y]), rank[at[x]], rank[at[y]], x, y)
        else:
            return
        if entry[0] <= caliper:
            heappush(heap, entry)

    def unlink(i: int) -> tuple[int, int]:
        dead[i] = True
        p, q = before[i], after[i]
        if p >= 0:
            after[p] = q
        if q >= 0:
            before[q] = p
        return p, q

    for i in range(n):
        meet(before[i], i)
    meet(n - 1, after[n - 1])
    while heap:
        _, a, b, x, y = heappop(heap)
        if dead[x] or dead[y]:
            continue
        if x >= n:
            front[x][k[y]] = v[y]
            over += range(at[y], end[y])
            meet(*unlink(y))
        elif rank[at[x]] == a and rank[at[y]] == b:
            lefts.append(at[x])
            rights.append(at[y])
            at[x] += 1
            at[y] += 1
            around = [unlink(i) for i in (x, y) if at[i] == end[i]]
            for i in (x, y):
                if not dead[i]:
                    meet(before[i], i)
                    meet(i, after[i])
            if len(around) == 2:
                meet(*around[1])
    return lefts, rights, over


def _pieces(caliper: float, cut: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For a partition: rows that are pairs now have both ids and their score as value, rows left over are as they came."""

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        # partitions are sorted by stratum, so that the first code and the last are those at the ends
        code = rows["stratum"].combine_chunks().dictionary_encode().indices.to_numpy()
        side = pc.is_null(rows["left_id"]).to_numpy().astype(np.int8)
        rank = np.where(side, *(pc.rank(rows[c], tiebreaker="dense").to_numpy() for c in ("right_id", "left_id")))
        order = np.lexsort((rank, side, rows["value"].to_numpy(), code))
        rows, code, side, rank = rows.take(pa.array(order)), code[order], side[order], rank[order]
        value = rows["value"].to_numpy()
        for k in (0, 1):
            v, c = value[side == k], code[side == k]
            if np.any((np.diff(v) > 0) & (np.diff(v) <= caliper * 2**-50) & (c[1:] == c[:-1])):
                # so close that rounding gives two values one distance: a row without ids says so
                yield from pa.Table.from_pylist([{}], rows.schema).to_batches()
                return
        a, b, over = _closest(code, value, side, rank, cut, caliper)
        a, b = pa.array(a, pa.int64()), pa.array(b, pa.int64())
        score = pc.abs(pc.subtract(rows["value"].take(a), rows["value"].take(b)))
        picked = {"stratum": rows["stratum"].take(a), "of": rows["of"].take(a), "left_id": rows["left_id"].take(a), "right_id": rows["right_id"].take(b), "value": score}
        yield from pa.table([picked[c] for c in rows.column_names], schema=rows.schema).to_batches()
        yield from rows.take(pa.array(over, pa.int64())).to_batches()

    return piece


def _greedy_line(rows: DataFrame, caliper: float) -> DataFrame | None:
    """(stratum, of, left_id, right_id, score) of rows (stratum, of, left_id, right_id, value) with one id; no pair is listed.

    The line of values is cut into pieces by range. A piece makes the pairs that nothing beyond its ends can change;
    rows that can't be told yet go to the next round, in half as many pieces at most, until one piece holds them. None
    where values differ by so little that their distances would be rounded to one.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "line")
    tasks, out = 0, None
    while True:
        pieces = max(1, -(-rows.count() // PIECE))
        tasks = min(pieces, max(1, tasks // 2)) if tasks else pieces
        line = rows.repartitionByRange(tasks, "stratum", "value") if tasks > 1 else rows.repartition(1)
        done = materialize(line.sortWithinPartitions("stratum", "value").mapInArrow(_pieces(caliper, tasks > 1), rows.schema), "greedy")
        release(spark, rows)
        if not done.where("left_id IS NULL AND right_id IS NULL").isEmpty():
            return None
        pairs = done.where("left_id IS NOT NULL AND right_id IS NOT NULL")
        out = pairs if out is None else out.unionByName(pairs)
        if tasks == 1:
            return out.withColumnRenamed("value", "score")
        rows = done.where("left_id IS NULL OR right_id IS NULL")


def greedy_match(left: DataFrame, right: DataFrame, stratum: str, value: str, caliper: float, id_col: str = "id", widened: float | None = None) -> DataFrame:
    """(stratum, left_id, right_id, score): one-to-one pairs of a stratum within the caliper, the closest first, ties by ids.

    With `widened`, rows that are left over are matched once more across all strata, within that caliper; their stratum is
    the left row's. Null strata, values and ids take no part.

    The closest free pair is always of neighbours by value, so that rows are gone through along the line of values by
    pieces, and no pairs are listed: memory of a task is a piece of rows, and what is written is rows and not pairs.
    Pairs are listed, in bins as wide as the caliper, and chosen by stable_pairs where values are no doubles, where
    two of them are apart by no more than distances are rounded by, and where ids repeat in a stratum or are no plain
    values.
    """

    def near(a: DataFrame, b: DataFrame, within: float, same: bool) -> DataFrame:
        wide = F.floor(F.col(value) / F.lit(within))
        a = a.select(F.col(stratum).alias("stratum"), F.col(id_col).alias("left_id"), F.col(value).alias("_x"), F.explode(F.sequence(wide - 1, wide + 1)).alias("_bin"))
        b = b.select(F.col(stratum).alias("_of"), F.col(id_col).alias("right_id"), F.col(value).alias("_y"), wide.alias("_bin"))
        met = a.join(b, (a["_bin"] == b["_bin"]) & (F.col("stratum") == F.col("_of"))) if same else a.join(b, a["_bin"] == b["_bin"])
        met = met.withColumn("score", F.abs(F.col("_x") - F.col("_y"))).where(F.col("score") <= within)
        return met.select("stratum", "left_id", "right_id", "score")

    def tier(a: DataFrame, b: DataFrame, within: float, same: bool) -> DataFrame:
        """(of, left_id, right_id, score), of the left row's stratum."""
        doubles = all(df.schema[value].dataType == T.DoubleType() for df in (a, b))
        if doubles and a.schema[stratum].dataType == b.schema[stratum].dataType and all(_plain(df, stratum, id_col) for df in (a, b)):
            of = F.col(stratum) if same else F.lit("")
            sides = [df.select(of.alias("stratum"), F.col(stratum).alias("of"), F.col(id_col).alias(name), F.col(value).alias("value")) for df, name in ((a, "left_id"), (b, "right_id"))]
            sides = [df.dropna().where(F.abs("value") < float("inf")) for df in sides]
            if not any(_repeats(df, "stratum", name) for df, name in zip(sides, ("left_id", "right_id"), strict=True)):
                found = _greedy_line(sides[0].unionByName(sides[1], allowMissingColumns=True), within)
                if found is not None:
                    return found.select("of", "left_id", "right_id", "score")
        pairs = near(a, b, within, same).withColumn("of", F.col("stratum"))
        return stable_pairs(pairs if same else pairs.withColumn("stratum", F.lit("")), ["score"], ["score"]).select("of", "left_id", "right_id", "score")

    first = tier(left, right, caliper, True).withColumnRenamed("of", "stratum")
    if widened is None:
        return first
    rest = left.join(first.select(F.col("stratum").alias(stratum), F.col("left_id").alias(id_col)), [stratum, id_col], "left_anti")
    other = right.join(first.select(F.col("stratum").alias(stratum), F.col("right_id").alias(id_col)), [stratum, id_col], "left_anti")
    return first.unionByName(tier(rest, other, widened, False).withColumnRenamed("of", "stratum"))


def nearest_rows(left: DataFrame, right: DataFrame, stratum: str, value: str, k: int, id_col: str = "id") -> DataFrame:
    """(stratum, left_id, right_id, score, rank): for each left row the k right rows of its stratum whose value is nearest,
    ties to the smaller id, rank from 1; fewer where the stratum has fewer.

    A stratum's right rows are spread over bins that hold about k of them, and a left row meets its own bin and the two
    beside it. Rows that do not find k within the width of a bin go on with bins 16 times as wide, until a bin is as
    wide as the values are apart. So a left row meets few right rows, however many its stratum has. Of right rows of one
    value the k smallest ids alone can count. Null strata, values and ids take no part.
    """
    spark = left.sparkSession
    a = left.select(F.col(stratum).alias("stratum"), F.col(id_col).alias("left_id"), F.col(value).cast("double").alias("x")).dropna()
    b = right.select(F.col(stratum).alias("stratum"), F.col(id_col).alias("right_id"), F.col(value).cast("double").alias("y")).dropna()
    b = b.withColumn("_r", F.row_number().over(Window.partitionBy("stratum", "y").orderBy("right_id"))).where(F.col("_r") <= k).drop("_r")
    b = materialize(b, "right")
    ends = b.groupBy("stratum").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    todo = a.join(ends, "stratum").withColumn("w", F.greatest((F.col("hi") - F.col("lo")) * k / F.col("n"), F.lit(1e-9)))
    far = F.greatest(F.abs(F.col("x") - F.col("lo")), F.abs(F.col("x") - F.col("hi")))
    todo, out = materialize(todo.withColumn("far", far).drop("n", "lo", "hi"), "todo"), None
    while not todo.isEmpty():
        widths = todo.groupBy("stratum").agg(F.max("w").alias("_w"))
        mine = todo.withColumn("bin", F.explode(F.sequence(F.floor(F.col("x") / F.col("w")) - 1, F.floor(F.col("x") / F.col("w")) + 1)))
        theirs = b.join(widths, "stratum").withColumn("bin", F.floor(F.col("y") / F.col("_w"))).drop("_w")
        met = mine.join(theirs, ["stratum", "bin"]).withColumn("score", F.abs(F.col("x") - F.col("y"))).where(F.col("score") <= F.col("w"))
        own = Window.partitionBy("stratum", "left_id").orderBy("score", "right_id")
        some = materialize(met.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("stratum", "left_id", "right_id", "score", "rank"), "near")
        full = some.where(F.col("rank") == k).select("stratum", "left_id")
        over = todo.where("far <= w").select("stratum", "left_id")
        done = full.unionByName(over).distinct()
        found = materialize(some.join(done, ["stratum", "left_id"], "left_semi"), "nearest")
        out = found if out is None else out.unionByName(found)
        rest = materialize(todo.join(done, ["stratum", "left_id"], "left_anti").withColumn("w", F.col("w") * 16), "todo")
        release(spark, todo, some)
        todo = rest
    if out is None:
        empty = a.join(b, "stratum").limit(0)
        return empty.select("stratum", "left_id", "right_id", F.col("x").alias("score"), F.lit(1).alias("rank"))
    return out


def suffix_matches(paths: DataFrame, patterns: DataFrame, id_col: str, path_col: str, pattern_col: str) -> DataFrame:
    """(id, pattern) of the paths that end with one pattern alone, whole or behind a slash.

    Each path is met with its own endings, one for each folder, by equality, so that no path is held against every
    pattern. Null paths and patterns take no part, patterns that repeat count once.
    """
    parts = F.split(path_col, "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    rows = paths.where(F.col(path_col).isNotNull()).select(id_col, F.explode(endings).alias(pattern_col))
    met = rows.join(patterns.select(pattern_col).distinct(), pattern_col)
    return met.groupBy(id_col).agg(F.min(pattern_col).alias(pattern_col), F.count("*").alias("_n")).where("_n = 1").drop("_n")


def match_versions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pair, before_id, after_id, match_status, change_kind) of the entities of two versions.

    Both sides have pair, id, path, symbol, statement, template and behavior; before has new_path as well, its path in
    the version after. Entities of one path and symbol match by a statement, a template or the symbol that is unique on
    both sides as they came, in this order. Where a template's entities differ in number, none of them matches. What
    is left is ambiguous if a counterpart of its place is left too, and unmatched otherwise. Null templates are equal.
    """
    place = ["pair", "_place", "symbol"]
    a = before.withColumn("_place", F.col("new_path")).withColumn("template", F.coalesce("template", F.lit("\0")))
    b = after.withColumn("_place", F.col("path")).withColumn("template", F.coalesce("template", F.lit("\0")))
    count = lambda df, keys, name: df.groupBy(*place, *keys).agg(F.count("*").alias(name))
    odd = count(a, ["template"], "_na").join(count(b, ["template"], "_nb"), [*place, "template"], "left")
    odd = odd.where("greatest(_na, coalesce(_nb, 0)) > 1 AND _na <> coalesce(_nb, 0)").select(*place, "template")
    able = a.join(odd, [*place, "template"], "left_anti")
    found = None
    for keys, basis in ((["statement"], "unique_semantic_statement"), (["template"], "unique_template"), ([], "unique_symbol_possible")):
        one = lambda df, name: df.groupBy(*place, *keys).agg(F.count("*").alias("_n"), F.min("id").alias(name)).where("_n = 1").drop("_n")  # noqa: B023, E731
        pairs = one(a, "before_id").join(one(b, "after_id"), [*place, *keys]).select("pair", "before_id", "after_id", F.lit(basis).alias("match_status"))
        pairs = pairs.join(able.select("pair", F.col("id").alias("before_id")), ["pair", "before_id"], "left_semi")
        if found is not None:
            pairs = pairs.join(found.select("pair", "before_id"), ["pair", "before_id"], "left_anti").join(found.select("pair", "after_id"), ["pair", "after_id"], "left_anti")
        # each pass reads those before it three times: written, they are read and not computed again
        found = materialize(pairs if found is None else found.unionByName(pairs), "matched")
    left = found.join(before.select("pair", F.col("id").alias("before_id"), F.col("path").alias("_pa"), F.col("behavior").alias("_ba")), ["pair", "before_id"])
    both = left.join(after.select("pair", F.col("id").alias("after_id"), F.col("path").alias("_pb"), F.col("behavior").alias("_bb")), ["pair", "after_id"])
    kind = F.when(F.col("_pa") != F.col("_pb"), "moved").when(F.col("_ba").eqNullSafe(F.col("_bb")), "unchanged").otherwise("modified")
    out = both.select("pair", "before_id", "after_id", "match_status", kind.alias("change_kind"))
    rest_a = a.join(found.select("pair", F.col("before_id").alias("id")), ["pair", "id"], "left_anti")
    rest_b = b.join(found.select("pair", F.col("after_id").alias("id")), ["pair", "id"], "left_anti")

    def leftover(own, other, kind, a_id, b_id):
        there = other.select(*place).distinct().withColumn("_there", F.lit(True))
        status = F.when(F.col("_there"), "ambiguous").otherwise("unmatched")
        return own.join(there, place, "left").select("pair", a_id.alias("before_id"), b_id.alias("after_id"), status.alias("match_status"), F.lit(kind).alias("change_kind"))

    none = lambda df: F.lit(None).cast(df.schema["id"].dataType)
    rest = leftover(rest_a, rest_b, "deleted", F.col("id"), none(b)).unionByName(leftover(rest_b, rest_a, "added", none(a), F.col("id")))
    return materialize(out.unionByName(rest), "pairs")


def match_moves(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """pairs of match_versions in which an unmatched deletion and an unmatched addition elsewhere, with a symbol and a
    statement that are unique on both sides, are one move; what could be several is ambiguous."""
    key = ["pair", "symbol", "statement"]
    gone = pairs.where("match_status = 'unmatched' AND change_kind = 'deleted'").join(before.select("pair", F.col("id").alias("before_id"), "symbol", "statement", F.col("path").alias("_pa")), ["pair", "before_id"])
    come = pairs.where("match_status = 'unmatched' AND change_kind = 'added'").join(after.select("pair", F.col("id").alias("after_id"), "symbol", "statement", F.col("path").alias("_pb")), ["pair", "after_id"])
    ga = gone.groupBy(*key).agg(F.count("*").alias("_ng"), F.collect_set("_pa").alias("_sa"), F.min("before_id").alias("b"))
    cb = come.groupBy(*key).agg(F.count("*").alias("_nc"), F.collect_set("_pb").alias("_sb"), F.min("after_id").alias("a"))
    # paths of each side: a counterpart must be in another file
    met = ga.join(cb, key).where(F.size(F.array_union("_sa", "_sb")) > 1)
    moved = met.where("_ng = 1 AND _nc = 1").select("pair", F.col("b").alias("before_id"), F.col("a").alias("after_id"))
    vague = met.where("NOT (_ng = 1 AND _nc = 1)").select(*key)
    vague_a = gone.join(vague, key, "left_semi").select("pair", "before_id").withColumn("_va", F.lit(True))
    vague_b = come.join(vague, key, "left_semi").select("pair", "after_id").withColumn("_vb", F.lit(True))
    rest = pairs.join(moved.select("pair", "before_id"), ["pair", "before_id"], "left_anti").join(moved.select("pair", "after_id"), ["pair", "after_id"], "left_anti")
    rest = rest.join(vague_a, ["pair", "before_id"], "left").join(vague_b, ["pair", "after_id"], "left")
    rest = rest.withColumn("match_status", F.when(F.col("_va") | F.col("_vb"), "ambiguous").otherwise(F.col("match_status"))).drop("_va", "_vb")
    moved = moved.withColumns({"match_status": F.lit("unique_cross_file_semantic"), "change_kind": F.lit("moved")})
    return rest.select(*pairs.columns).unionByName(moved.select(*pairs.columns))


def override_pairs(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """pairs with those that a named reviewer chose (pair, before_id, after_id, reviewer) in place of ambiguous ones.

    A choice counts once for each entity, and only where both of its entities are ambiguous in pairs; others are left
    out. after_id null says that the entity is gone.
    """
    vague = pairs.where("match_status = 'ambiguous'")
    good = chosen.where(F.trim("reviewer") != "").join(vague.where("before_id IS NOT NULL").select("pair", "before_id").distinct(), ["pair", "before_id"], "left_semi")
    has = good.where("after_id IS NOT NULL").join(vague.where("after_id IS NOT NULL").select("pair", "after_id").distinct(), ["pair", "after_id"], "left_semi")
    good = has.select("pair", "before_id", "after_id", "reviewer").unionByName(good.where("after_id IS NULL").select("pair", "before_id", "after_id", "reviewer"))
    for key in ("before_id", "after_id"):
        once = good.groupBy("pair", key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).where(F.col(key).isNotNull())
        good = good.join(once.select("pair", key), ["pair", key], "left_anti")
    rest = pairs.join(good.select("pair", "before_id"), ["pair", "before_id"], "left_anti").join(good.select("pair", "after_id"), ["pair", "after_id"], "left_anti")
    kind = F.when(F.col("after_id").isNull(), "deleted").otherwise("modified")
    return rest.select(*pairs.columns).unionByName(good.select("pair", "before_id", "after_id", F.lit("human_selected").alias("match_status"), kind.alias("change_kind")))


#: Left rows that caliper_match gives to one block of time, at least; a block has SHARE and a bin at most.
BLOCK = 1 << 14


def _choices(days: float, ratio: float, columns: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Of one block: its left rows, in order of time and id, each with the best right row near it that is free."""

    def choose(block: pa.Table) -> pa.Table:
        a = block.filter(pc.field("left_id").is_valid()).sort_by([("micros", "ascending"), ("left_id", "ascending")])
        b = block.filter(pc.field("right_id").is_valid() & ~pc.field("taken")).sort_by("day")
        (ta, sa, la), (tb, sb, lb) = ([side[c].to_numpy() for c in ("day", "more", "log")] for side in (a, b))
        rank = pc.rank(b["right_id"], tiebreaker="dense").to_numpy()
        free = np.ones(len(tb), bool)
        low, high = np.searchsorted(tb, ta - days - 1e-6), np.searchsorted(tb, ta + days + 1e-6, "right")
        found = []
        for i in range(len(ta)):
            near = low[i] + np.flatnonzero(free[low[i] : high[i]])
            apart, size = np.abs(ta[i] - tb[near]), sb[near]
            times = np.maximum(sa[i], size) / np.minimum(sa[i], size)
            ok = np.flatnonzero((apart <= days) & (times <= ratio))
            if not len(ok):
                continue
            score = np.abs(la[i] - lb[near[ok]]) + apart[ok] / 365
            best = ok[score == score.min()]
            k = min(best, key=lambda x: (apart[x], times[x], rank[near[x]])) if len(best) > 1 else best[0]
            free[near[k]] = False
            found.append((i, near[k], apart[k], times[k], score.min()))
        i, j, *values = zip(*found, strict=True) if found else ([],) * 5
        i, j = pa.array(i, pa.int64()), pa.array(j, pa.int64())
        picked = [a["stratum"].take(i), a["block"].take(i), a["left_id"].take(i), b["right_id"].take(j), *[pa.array(v, pa.float64()) for v in values]]
        return pa.table(picked, columns)

    return choose


def caliper_match(left: DataFrame, right: DataFrame, stratum: str, days: float, ratio: float) -> DataFrame:
    """(stratum, left_id, right_id, days, ratio, score): each left row, in order of time, with the nearest right row that
    is still free, at most `days` away and at most `ratio` times as large or small. Sides have id, time and size.

    A stratum's time is cut into blocks of about so many left rows each, and right rows come to the blocks that they are
    near. A block is gone through in order of time, with no pair listed. All blocks begin as if no earlier one
    had taken a right row of theirs; those for which that was wrong are gone through again with what earlier ones took,
    until none is left. The first block of a stratum is right at once, each later one at the latest a round after the
    one before. Where ids repeat in a stratum or are no plain values, all pairs are listed and the choice is that of stable_pairs: that the
    earlier left row comes first is what every right row prefers. Nulls in stratum, id, time and size take no part.
    """
    spark = left.sparkSession
    day = F.unix_micros("time") / 86_400e6

    def side(df: DataFrame, name: str) -> DataFrame:
        df = df.select(F.col(stratum).alias("stratum"), F.col("id").alias(f"{name}_id"), F.col("time"), F.unix_micros("time").alias("micros"), day.alias("day"), F.col("size"))
        return df.withColumns({"more": (F.col("size") + 1).cast("double"), "log": F.log1p("size"), "bin": F.floor(F.col("day") / (2 * days))}).dropna()

    a, b = materialize(side(left, "left"), "left"), materialize(side(right, "right"), "right")
    if not _plain(a, "left_id") or not _plain(b, "right_id") or _repeats(a, "stratum", "left_id") or _repeats(b, "stratum", "right_id"):
        return _listed_caliper(a, b, days, ratio)
    share = min(SHARE, max(BLOCK, -(-a.count() // spark.sparkContext.defaultParallelism)))
    before = F.sum("n").over(Window.partitionBy("stratum").orderBy("bin")) - F.col("n")
    bins = materialize(a.groupBy("stratum", "bin").agg(F.count("*").alias("n")).withColumn("block", F.floor(before / share)).drop("n"), "bins")
    reach = bins.select("stratum", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)).alias("bin"), "block").distinct()
    own, near = (df.join(blocks, ["stratum", "bin"]).drop("bin", "time", "size") for df, blocks in ((a, bins), (b, reach)))
    rows = materialize(own.unionByName(near, allowMissingColumns=True).withColumn("taken", F.lit(False)), "blocks")
    tasks = 4 * bins.select("stratum", "block").distinct().count()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = [f"{c} {kinds[c]}" for c in ("stratum", "block", "left_id", "right_id")] + ["days double", "ratio double", "score double"]

    def through(some: DataFrame) -> DataFrame:
        dealt = some.repartition(max(1, tasks), "stratum", "block").groupBy("stratum", "block")
        return dealt.applyInArrow(_choices(days, ratio, [c.split()[0] for c in columns]), ", ".join(columns))

    chosen = materialize(through(rows), "chosen")
    while True:
        first = chosen.groupBy("stratum", "right_id").agg(F.min("block").alias("_by"))
        now = rows.join(first, ["stratum", "right_id"], "left").withColumn("_now", F.coalesce(F.col("_by") < F.col("block"), F.lit(False)))
        now = materialize(now.select(*rows.columns, "_now"), "blocks")
        wrong = materialize(now.where("_now <> taken").select("stratum", "block").distinct(), "wrong")
        if wrong.isEmpty():
            release(spark, a, b, bins, rows, now, wrong)
            return chosen.drop("block")
        again = through(now.withColumn("taken", F.col("_now")).drop("_now").join(wrong, ["stratum", "block"], "left_semi"))
        done = materialize(chosen.join(wrong, ["stratum", "block"], "left_anti").unionByName(again), "chosen")
        release(spark, rows, chosen, wrong)
        rows, chosen = now.withColumn("taken", F.col("_now")).drop("_now"), done
        rows._made_at = now._made_at


def _listed_caliper(a: DataFrame, b: DataFrame, days: float, ratio: float) -> DataFrame:
    """caliper_match by its pairs, for ids that repeat; rows in neighbouring bins of time meet."""
    a = a.select("stratum", "left_id", F.col("day").alias("_ta"), F.col("time").alias("left_time"), F.col("size").alias("_sa"), F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)).alias("bin"))
    b = b.select("stratum", "right_id", F.col("day").alias("_tb"), F.col("size").alias("_sb"), "bin")
    met = a.join(b, ["stratum", "bin"])
    met = met.withColumns({"days": F.abs(F.col("_ta") - F.col("_tb")), "ratio": (F.greatest("_sa", "_sb") + 1) / (F.least("_sa", "_sb") + 1)})
    met = met.where((F.col("days") <= days) & (F.col("ratio") <= ratio)).withColumn("score", F.abs(F.log1p("_sa") - F.log1p("_sb")) + F.col("days") / 365)
    met = met.select("stratum", "left_id", "right_id", *[F.col(c).cast("double").alias(c) for c in ("days", "ratio", "score")], "left_time")
    return stable_pairs(met, ["score", "days", "ratio"], ["left_time"]).drop("left_time")


def maximum_match(pairs: DataFrame) -> DataFrame:
    """(stratum, left_id, right_id): as many one-to-one pairs of (stratum, left_id, right_id) as there can be.

    A maximal choice by ids comes first. Then, in phases, a search goes out from all left rows without a partner at once,
    along pairs to right rows not yet seen and back along chosen pairs, a layer at a time; each right row belongs to one
    root, the smallest that reaches it, so that the ways of different roots have no row in common. Where a layer meets
    right rows without a partner, one way for each root is turned round, which gives a pair more for each. A phase that
    meets none ends it. A layer is a join and an aggregation over the pairs; a stratum, of any size, is no group.

    Null ids take no part, a null stratum is one. Repeated pairs count once. Empty table: no rows.
    """
    spark = pairs.sparkSession
    key = ["stratum"]
    none = F.lit("\0")
    edges = pairs.dropna(subset=["left_id", "right_id"]).select(F.coalesce(F.col("stratum").cast("string"), none).alias("stratum"), "left_id", "right_id").distinct()
    edges = materialize(edges, "edges")
    chosen = stable_pairs(edges, [], [])
    while True:
        roots = edges.select("stratum", "left_id").distinct().join(chosen, [*key, "left_id"], "left_anti")
        front = materialize(roots.withColumn("root", F.col("left_id")), "front")
        tree, layers, ends = None, [], None
        while not front.isEmpty():
            reach = front.join(edges, [*key, "left_id"])
            if tree is not None:
                reach = reach.join(tree.select("stratum", "right_id"), [*key, "right_id"], "left_anti")
            layer = reach.groupBy(*key, "right_id").agg(F.min(F.struct("root", "left_id")).alias("x")).select("stratum", "right_id", "x.root", F.col("x.left_id").alias("parent"))
            layer = materialize(layer, "layer")
            layers.append(layer)
            tree = layer if tree is None else tree.unionByName(layer)
            free = layer.join(chosen, [*key, "right_id"], "left_anti")
            ends = materialize(free.groupBy(*key, "root").agg(F.min(F.struct("right_id", "parent")).alias("x")).select("stratum", "root", "x.*"), "ends")
            if not ends.isEmpty():
                break
            front = materialize(layer.join(chosen, [*key, "right_id"]).select("stratum", "left_id", "root"), "front")
            ends = None
        if ends is None:
            break
        # back from each end, a layer at a time: the parent takes the right row and gives up its own, which is next
        turned, way = None, ends
        for layer in reversed(layers):
            new = way.select("stratum", F.col("parent").alias("left_id"), "right_id")
            turned = new if turned is None else turned.unionByName(new)
            given = new.select("stratum", "left_id").join(chosen, [*key, "left_id"]).select("stratum", "right_id")
            way = given.join(tree, [*key, "right_id"]).select("stratum", "root", "right_id", "parent")
            way = materialize(way, "way")
        turned = materialize(turned, "turned")
        chosen = materialize(chosen.join(turned, [*key, "left_id"], "left_anti").unionByName(turned.select(*chosen.columns)), "chosen")
        release(spark, *layers, ends)
    kind = pairs.schema["stratum"].dataType
    return chosen.select(F.when(F.col("stratum") != none, F.col("stratum")).cast(kind).alias("stratum"), "left_id", "right_id")


#: Pairs that log_distances gives to one task, about.
PAIRS = 1 << 26


def log_distances(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """(a_id, b_id, score): lines.log_distance of every pair of rows that agree in the columns on.

    a and b have id, ext, size, files, time and the columns on; a null in on pairs with nothing. All pairs are listed,
    so that the work grows with their number; what depends on one row is computed once for the row, and the distance of
    endings once for two lists of endings. Pairs are counted from the groups' sizes first, and there are as many tasks as
    they ask for: a group of too many is cut by b's ids, with a's rows in each share. Of a task's rows those of one group
    and share of b are in memory.
    """
    spark = a.sparkSession
    side = lambda df, x: df.select(*on, F.col("id").alias(f"{x}_id"), F.col("ext").alias(f"{x}_ext"), F.log1p("size").alias(f"{x}_log"), F.col("files").alias(f"{x}_files"), F.unix_micros("time").alias(f"{x}_micros"))
    a, b = side(a, "a"), side(b, "b")
    sizes = lambda df, x: df.groupBy(*on, f"{x}_ext").agg(F.count("*").alias(f"{x}_n"))
    groups = materialize(sizes(a, "a").join(sizes(b, "b"), on).withColumn("language", lines.language_distance(F.col("a_ext"), F.col("b_ext"))), "pair-groups")
    pairs, most = groups.groupBy(*on, "b_ext").agg(F.sum(F.col("a_n") * F.col("b_n")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-pairs // PAIRS))
    shares = max(1, -(-8 * most // PAIRS))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on] + [F.col("x.a_ext").eqNullSafe(F.col("y.a_ext"))]
    left = a.alias("x").join(groups.alias("y"), same).select(*[f"x.{c}" for c in on], "a_id", "a_log", "a_files", "a_micros", "b_ext", "language")
    left = left.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    right = b.withColumn("share", F.pmod(F.hash("b_id"), F.lit(shares)))
    # endings as text, null or not, so that both sides' keys are of one type and stay where they are dealt
    keys = [*on, "share", "ends"]
    left, right = (df.withColumn("ends", F.to_json(F.struct("b_ext"))).drop("b_ext").repartition(tasks, *keys) for df in (left, right))
    score = lines.weighed(*map(F.col, ("language", "a_log", "b_log", "a_files", "b_files", "a_micros", "b_micros")))
    return left.join(right.hint("merge"), keys).select("a_id", "b_id", score.alias("score"))
