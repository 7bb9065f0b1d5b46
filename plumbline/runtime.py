"""Session helpers: the shared folder, cut lineage, table reading."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_DIR = "file:///tmp/checkpoints/plumbline"
#: Rows that dealt gives to one task.
SHARE = 1 << 19
#: Folders that materialize of this driver made and release has not deleted.
_MADE: set[str] = set()


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme, as Spark's own readers and writers would take it.

    A path without a scheme lies in the default file system. If that is a machine's own disk and the master is not
    local, other machines would not see it, which is an error; a folder that is mounted everywhere is named by file://.
    """
    whole = with_scheme(spark, path)
    if whole != path and whole.startswith("file:") and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"{path} names a machine's own disk; name a folder that all machines share, with its scheme")
    return whole


def with_scheme(spark: SparkSession, path: str) -> str:
    """qualified for what all machines share by contract: inputs, and the folder that the session names for it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return path
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is spark.checkpoint.dir of the session, or else the context's checkpoint folder. Both are shared by what Spark
    says of them, with a scheme or without one, such as a disk that is mounted on all machines. Where neither is set, as
    in tests, a local folder is set; on a cluster, whose machines don't share one, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return with_scheme(spark, named.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"{OWN_DIR}/{spark.sparkContext.applicationId}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; no two calls share one."""
    return f"{shared_dir(spark)}/plumbline/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs no more than the tasks it ran. The schema is passed on, so that
    reading starts no job.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    _MADE.add(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._made_at = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, with as many underscores behind it as make it none of the columns, in whatever case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key into so many partitions that each has about SHARE rows, however many rows there are.

    Where nearly every row is a group of its own, a task of a grouping by key holds its rows in memory, and tasks by
    bytes of files or shuffles have millions of such small rows. For keys of few rows each: all rows of a key meet.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SHARE)), key)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Let go of the shuffle files of finished jobs, and delete tables of materialize that nothing reads any more.

    Only what materialize itself returned is deleted, once; any other table that is given stays as it is, wherever it
    lies, and its files are not even listed. Spark's cleaner drops shuffle files once the driver has collected the
    objects that stand for them, which else may be long after; in an operator of many jobs that would keep every
    stage's files on the disks until the end.
    """
    for df in tables:
        path = getattr(df, "_made_at", None)
        if path in _MADE:
            _MADE.discard(path)
            drop_path(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
