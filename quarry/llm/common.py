"""Helpers that the operators share: tables, shared folder, components of a graph."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, and what is a word to every contract of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where none is named, a session in one process (tests) gets a
    temporary one; a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it again.

    The table outlives lost executors.  The shuffle files of the finished step are
    released at once, so that steps don't add up on disk.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    release(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table._quarry_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes materialized tables that no later step reads."""
    for table in tables:
        delete(table.sparkSession, table._quarry_path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files that no plan refers to any more.

    The cleaner works behind the collector: what one round unlinks, the next one finds.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(key: str, *parts: Column) -> Column:
    """64 hex digits that only a holder of the key can derive."""
    inner = F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)
    return F.sha2(F.concat(F.lit(key), inner), 256)


def again(digest: Column, n: Column) -> Column:
    """The n-th digest (64 hex digits) derived from one; the 0th is the digest itself."""
    return F.when(n == 0, digest).otherwise(F.sha2(F.concat(digest, n.cast("string")), 256))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) for each node that
    has an edge, component being the smallest node that it reaches.

    Alternating large-star and small-star steps, so a chain needs a logarithmic number of
    rounds; each round is a written table.  Neighbour lists are never gathered: a star's
    centre needs only a minimum, which is combined before the shuffle.
    """
    big, small = F.greatest("a", "b"), F.least("a", "b")
    now = materialize(edges.select(big.alias("u"), small.alias("v")).where("u > v").distinct(), name)
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), name)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = materialize(large, name)
        drop(now, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), name)
        linked = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(linked.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
        drop(large, least)
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
