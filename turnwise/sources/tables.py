"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The least bytes of a file that are worth a task of their own.
LEAST_BYTES = 1 << 18


def spread(df: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """The rows over as many tasks as there are cores, where the files have fewer splits than that.

    A table in one small file, or in few row groups, would be worked on by one core.  A table with at least
    as many splits as cores, as every large one, is left as it is and not shuffled; so is one too small
    to give each task ``least`` bytes.
    """
    query = df._jdf.queryExecution()
    size = int(str(query.optimizedPlan().stats().sizeInBytes()))
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, size // least)
    if wanted <= 1 or query.toRdd().getNumPartitions() >= wanted:
        return df
    return df.repartition(int(wanted))


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """``<base>/<name>.parquet``, a file or a folder of files."""
    return spread(spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet"))
