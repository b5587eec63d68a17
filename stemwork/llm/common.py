"""Helpers that the operators of this subpackage share: inputs, scratch tables, running totals."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: ASCII white space, the separators of words in every contract of this subpackage.
SPACE = r"[\x20\x09-\x0D]+"

FILTER_WORDS = 1 << 18
_local_scratch: list[str] = []
_here = threading.local()


def tables_written() -> list[str]:
    """Tables that this thread has written to the shared folder, in their order."""
    if not hasattr(_here, "paths"):
        _here.paths = []
    return _here.paths


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="stemwork-"))
    return f"file://{_local_scratch[0]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint; Spark's cleaner drops the files with the DataFrame."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: recomputation never passes this point."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stemwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    tables_written().append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Writes df to the shared folder in buckets by key, one for each shuffle partition: joins on key then move the other side alone."""
    spark = df.sparkSession
    place = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/stemwork/{place}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(f"stemwork_{place}")
    tables_written().append(path)
    return spark.table(f"stemwork_{place}")


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that no more of them become Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def least_nodes(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each of n nodes' component: union-find by hooking roots on smaller ones, then jumping to the roots."""
    parent = np.arange(n)
    while len(u):
        ru, rv = parent[u], parent[v]
        apart = ru != rv
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while (up := parent[parent])[parent != up].size:
            parent = up
    return parent


def likely(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """rows less most of those whose key isn't in chosen, so that their texts needn't be moved to find that out.

    A Bloom filter with one hash: FILTER_WORDS longs at most, whatever the size of chosen, are broadcast. Rows
    whose key is in chosen all stay.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS * 64))
    at = lambda df: df.withColumn("_word", F.floor(place / 64)).withColumn("_bit", F.pmod(place, F.lit(64)).cast("int"))
    words = at(chosen).groupBy(F.col("_word").alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    return at(rows).join(F.broadcast(words), F.col("_word") == F.col("_w")).where(F.getbit("_bits", "_bit") == 1).drop("_word", "_bit", "_w", "_bits")


def release(spark: SparkSession, start: int) -> None:
    """Deletes the tables written since there were `start` of them, but for the last, through Spark's file systems."""
    for path in tables_written()[start:-1]:
        name = path.rpartition("/")[2]
        if "-" not in name:  # bucketed ones are in the catalog too
            spark.sql(f"DROP TABLE IF EXISTS stemwork_{name}")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del tables_written()[start:-1]


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds `out`, the inclusive running sum of `value` by `keys` in the order (bucket, *order).

    No task gets a whole key: rows are windowed by (keys, bucket), and the sums of the buckets, at most
    as many rows for each key as there are buckets, give each bucket's start. Null keys are a key.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_rt_sum"))
    by_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = F.sum("_rt_sum").over(by_key.orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)) - F.col("_rt_sum")
    starts = sums.select(*[F.col(k).alias(f"_rt_k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("_rt_b"), before.alias("_rt_start"))
    within = F.sum(value).over(W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    on = F.col(bucket) == F.col("_rt_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_rt_k{i}"))
    return (
        df.withColumn("_rt_within", within)
        .join(starts, on)
        .withColumn(out, F.col("_rt_within") + F.col("_rt_start"))
        .drop("_rt_within", "_rt_start", "_rt_b", *[f"_rt_k{i}" for i in range(len(keys))])
    )
