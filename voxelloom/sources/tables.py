"""Stored tables: blocks, slots of an output, points, affines, transforms, listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "point_id bigint, c bigint, z double, y double, x double, intensity double"


def write_blocks(blocks: DataFrame, path: str, by=("c", "scale")) -> None:
    """Block table as parquet, partitioned so that channel and scale selections prune.

    `rebalance` keeps files even when one partition holds most of the blocks.
    """
    blocks.hint("rebalance").write.mode("overwrite").partitionBy(*by).parquet(path)


def write_slot(df: DataFrame, path: str, by=("t", "c")) -> None:
    """Replace only the (t, c) slots present in `df`; other slots stay."""
    df.hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_points(points: DataFrame, path: str, keys=("ds",)) -> None:
    """CSV with a header, one folder per key.

    A key's rows meet before they are written: else every task would write a file in every folder.
    """
    points.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).csv(path, header=True)


def read_points(spark: SparkSession, path: str, keys="ds bigint") -> DataFrame:
    schema = f"{POINTS}, {keys}" if keys else POINTS
    return spark.read.schema(schema).csv(path, header=True)


def write_affines(affines: DataFrame, path: str, keys=("ds", "seq")) -> None:
    """Text matrices of three rows of four numbers, one folder per affine."""
    rows = [F.concat_ws(" ", *[F.col("m")[4 * i + j].cast("string") for j in range(4)]) for i in range(3)]
    text = affines.select(*keys, F.concat_ws("\n", *rows).alias("value"))
    text.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).text(path)


def read_affines(spark: SparkSession, path: str) -> DataFrame:
    """Text matrices (3x4 or 4x4) with the partition keys of their folder."""
    text = spark.read.text(path, wholetext=True)
    numbers = F.filter(F.split(F.regexp_replace("value", r"[\s,]+", " "), " "), lambda s: s != "")
    return text.withColumn("m", F.slice(F.transform(numbers, lambda s: s.cast("double")), 1, 12)).drop("value")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a completely written table lies at `path`."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    done = hadoop.Path(f"{path.rstrip('/')}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def reuse(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The stored result when there is one, else compute and store it."""
    if not exists(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def matches_output(path: Column, stem: str, ext: str) -> Column:
    """Whether a file name starts with `stem` and ends with `.ext`."""
    return F.element_at(F.split(path, "/"), -1).rlike(rf"^\Q{stem}\E.*\.\Q{ext}\E$")


def list_outputs(spark: SparkSession, root: str, stem: str, ext: str) -> DataFrame:
    """Files below `root` by stem and extension; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(matches_output(F.col("path"), stem, ext)).select("path", "length")
