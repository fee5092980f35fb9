"""Session helpers: reading tables, cutting lineage, and finding hot keys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with fewer rows than this is never treated apart; its group fits one task.
HOT_ROWS = 200_000
#: Hot keys beyond this are joined by a shuffle instead of a broadcast.
HOT_KEYS = 20_000

_CUT: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table NAME of a directory, a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, only where that is unset and all runs in this process, an own one that ends
    with it. On a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", f"file://{at}")
        atexit.register(shutil.rmtree, at, True)
    return spark.conf.get("spark.checkpoint.dir")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame as a table in the shared folder and read it back, so that its lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, deleted as the tables of cut() are."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _CUT.append(path)
    if path.startswith("file:"):
        atexit.register(shutil.rmtree, path.removeprefix("file://"), True)
    return path


def release(spark: SparkSession) -> int:
    """Delete the tables that cut() wrote in this process; call it when no DataFrame made from them is needed any more."""
    n = len(_CUT)
    while _CUT:
        path = spark._jvm.org.apache.hadoop.fs.Path(_CUT.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def hot_keys(df: DataFrame, keys: list[str], rows: int = HOT_ROWS, most: int = HOT_KEYS) -> DataFrame | None:
    """(*KEYS, _n) of the keys that hold more than ROWS rows, or None. The bound is the same at every size of the input. Up to MOST keys are
    marked for broadcast; more stay a written table, for shuffled joins."""
    found = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows), "hot-keys")
    return bounded(found, most) if found.head(1) else None


def split_hot(df: DataFrame, keys: list[str], rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of hot ones (None if there are none)."""
    hot = hot_keys(df, keys, rows)
    if hot is None:
        return df, None
    named = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    match = reduce(Column.__and__, [df[k].eqNullSafe(F.col(f"_hot_{k}")) for k in keys])
    return df.join(named, match, "left_anti"), df.join(named, match, "left_semi")


def small(df: DataFrame, most_rows: int) -> list:
    """Collect a table that must be small; raises when it has more than MOST_ROWS rows."""
    got = df.limit(most_rows + 1).collect()
    if len(got) > most_rows:
        raise ValueError(f"more than {most_rows} rows where a small table is needed")
    return got


def passes(df: DataFrame, key: str, most_rows: int) -> tuple[int, Iterator[list]]:
    """How many lists of about MOST_ROWS rows DF is, and the lists one after another, so that the driver holds one at a time. All rows of
    a key are in one list."""
    got = df.limit(most_rows + 1).collect()
    if len(got) <= most_rows:
        return (1, iter([got])) if got else (0, iter(()))
    del got
    held = cut(df, "passes")
    n = -(-held.count() // most_rows)
    return n, (held.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i).collect() for i in range(n))


def bounded(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """DF for a join: collected and marked for broadcast if it has at most MOST_ROWS (short) rows, else as it is, for a shuffled join."""
    got = df.limit(most_rows + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(got, df.schema)) if len(got) <= most_rows else df


def cumulated(counts: DataFrame, by: list[str], value: str, n: str = "n") -> DataFrame:
    """COUNTS (*BY, VALUE, N), one row per value, with `upto`, the sum of N over the values of its group up to and with its own. Values are
    ordered in ranges of partitions, so no task sorts a whole group."""
    ranged = counts.repartitionByRange(*[F.col(c) for c in [*by, value]]) if by else counts.repartitionByRange(F.col(value))
    held = cut(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_part", *by).orderBy(value)
    sums = held.groupBy("_part", *by).agg(F.sum(n).alias("_s"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = bounded(sums.select("_part", *[F.col(c).alias(f"_by_{c}") for c in by], F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before")).withColumnRenamed("_part", "_at"))
    match = reduce(Column.__and__, [F.col("_part") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]])
    return held.withColumn("upto", F.sum(n).over(own)).join(before, match).withColumn("upto", F.col("upto") + F.col("_before")).select(*counts.columns, "upto")


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark."""
    os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("quernstone")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
