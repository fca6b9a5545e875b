"""What the corpus operators share: stored tables, bounded Arrow batches, inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.stored import shared_dir, stash

__all__ = ["lean", "shared_dir", "stash", "table"]


def lean(df: DataFrame) -> SparkSession:
    """The session of df, its Arrow batches bounded: texts and sets are long, so batches of 10 000 rows are large."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
