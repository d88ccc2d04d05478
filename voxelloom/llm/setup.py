"""Session settings of the subpackage and written intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelloom.session import configure, scratch_path

#: Arrow batches stay small where texts are long.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def ready(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """`df` with columns named like one of `names` (in any case) under other names, and how to select every column back."""
    taken = {n.lower() for n in names}
    held = {c: f"__own_{c}" if c.lower() in taken else c for c in df.columns}
    return df.withColumnsRenamed({c: h for c, h in held.items() if c != h}), {c: F.col(f"`{h}`").alias(c) for c, h in held.items()}


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of `df` has (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` written to the shared folder and read back: later reads survive any lost executor.  `options` of the writer."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
