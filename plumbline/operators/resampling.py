"""Bootstrap over clusters and sign-flip tests, with replicates from hashes instead of a random stream."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.runtime import materialize

#: Draws of two_sample_bootstrap that one task makes.
DRAWS = 1 << 14


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(mean, lo, hi): the mean of all rows and its 95 percent interval, whole clusters drawn with replacement.

    Rows fold into one sum and count for each cluster. How often a cluster is drawn into a replicate is a Poisson
    number of mean 1 that an md5 of seed, replicate and cluster gives, so that clusters are drawn apart from each other
    and no list of clusters is ever in one place. Null values count nowhere; a null cluster is one.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(F.col(cluster).alias("c")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n"))
    drawn = sums.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.coalesce(F.col("c").cast("string"), F.lit(""))))
    u = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 2**32
    times, p, total = F.lit(0), 2.718281828459045**-1, 0.0
    for k in range(1, 9):  # the share beyond 8 is under a millionth
        total += p
        times = times + (u >= total).cast("int")
        p /= k
    each = drawn.withColumn("t", times).groupBy("b").agg((F.sum(F.col("s") * F.col("t")) / F.sum(F.col("n") * F.col("t"))).alias("m"))
    interval = each.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    return sums.agg((F.sum("s") / F.sum("n")).alias("mean")).join(interval, F.lit(True))


def sign_flip(df: DataFrame, cluster: str, value: str, most: int = 18) -> DataFrame:
    """(mean, p): the mean of the clusters' means and the exact share of sign patterns whose mean is as far from zero.

    All 2^k patterns of k clusters are rows made from a range, k at most `most`; beyond that use the bootstrap.
    """
    means = df.where(F.col(value).isNotNull()).groupBy(F.col(cluster).alias("c")).agg(F.avg(value).alias("m"))
    values = [r.m for r in means.orderBy("c").limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"more than {most} clusters")
    k, own = len(values), abs(sum(values))
    total = F.lit(0.0)
    for i, v in enumerate(values):
        total = total + F.when(F.shiftright("id", i).bitwiseAND(F.lit(1)) == 1, F.lit(v)).otherwise(F.lit(-v))
    far = F.avg((F.abs(total) >= F.lit(own - 1e-12)).cast("double"))
    return df.sparkSession.range(1 << k).agg(F.lit(sum(values) / k if k else None).cast("double").alias("mean"), far.alias("p"))


def sign_flip_sampled(df: DataFrame, cluster: str, value: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """(mean, p): sign_flip for any number of clusters: of `draws` random sign patterns, and the observed one, the share
    whose mean is as far from zero. Signs come from an xxhash64 of seed, draw and cluster; 60 draws are one hash's bits."""
    means = df.where(F.col(value).isNotNull()).groupBy(F.col(cluster).alias("c")).agg(F.avg(value).alias("m"))
    groups = means.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 60))))
    bits = groups.withColumn("h", F.xxhash64(F.lit(seed), "g", F.coalesce(F.col("c").cast("string"), F.lit(""))))
    # one sum for each draw of the group, with the sums of all clusters combined before they are exchanged
    sums = bits.groupBy("g").agg(*[F.sum(F.when(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1)) == 1, F.col("m")).otherwise(-F.col("m"))).alias(f"s{i}") for i in range(60)])
    each = sums.select("g", F.posexplode(F.array(*[F.col(f"s{i}") for i in range(60)])).alias("i", "s")).where(F.col("g") * 60 + F.col("i") < draws)
    own = means.agg(F.sum("m").alias("t"), F.count("*").alias("k"))
    far = each.crossJoin(own).agg(F.max("k").alias("k"), F.max("t").alias("t"), F.count_if(F.abs("s") >= F.abs("t") - 1e-12).alias("far"), F.count("*").alias("n"))
    return far.select(F.when(F.col("k") > 0, F.col("t") / F.col("k")).alias("mean"), ((F.col("far") + 1) / (F.col("n") + 1)).alias("p"))


def poisson(n: Column, *key: Column) -> Column:
    """A Poisson number of mean n that the key's hashes give: exact below 32 by going through its distribution, beyond it
    the rounded normal one of that mean and variance."""
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(salt), *key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    first = F.struct(F.exp(-n).alias("p"), F.exp(-n).alias("c"), F.lit(0).alias("t"), uniform(1).alias("u"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * n / k
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), (a["t"] + (a["u"] >= a["c"]).cast("int")).alias("t"), a["u"].alias("u"))

    few = F.aggregate(F.sequence(F.lit(1), F.lit(96)), first, step, lambda a: a["t"])
    z = F.sqrt(-2 * F.log(uniform(2))) * F.cos(uniform(3) * (2 * pi))
    return F.when(n < 32, few).otherwise(F.greatest(F.lit(0), F.round(n + F.sqrt(n) * z))).cast("long")


def two_sample_bootstrap(df: DataFrame, side: str, value: str, scales: tuple[float, float] = (1.0, 1.0), replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(effect, lo, hi): the difference of the two sides' means, each times its scale, and its 95 percent interval, rows
    drawn with replacement; side is boolean.

    Rows fold by side and value first. Of a value that n rows have, a replicate draws a Poisson number of mean n, which a
    hash of seed, side, value and replicate gives: so what is drawn are values, not rows, results do not depend on
    partitions or the rows' order, and sums are combined before they are exchanged. Values are dealt into tasks of about
    DRAWS draws, since the folded table is small where the work on it is not. Null sides and values count nowhere.
    """
    own = df.where(F.col(side).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(side).alias("s"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    own = materialize(own, "folded")
    scaled = F.col("v") * F.when(F.col("s"), F.lit(float(scales[0]))).otherwise(F.lit(float(scales[1])))
    means = lambda rows, t: F.sum(F.when(rows, scaled * t)) / F.sum(F.when(rows, t))
    effect = means(F.col("s"), F.col("n")) - means(~F.col("s"), F.col("n"))
    drawn = own.repartition(max(1, -(-own.count() * replicates // DRAWS)), "s", "v").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = drawn.withColumn("t", poisson(F.col("n").cast("double"), F.lit(seed), F.col("s"), F.col("v"), F.col("b")))
    each = drawn.groupBy("b").agg((means(F.col("s"), F.col("t")) - means(~F.col("s"), F.col("t"))).alias("e"))
    interval = each.agg(F.percentile("e", 0.025).alias("lo"), F.percentile("e", 0.975).alias("hi"))
    return own.agg(effect.alias("effect")).join(interval, F.lit(True))
