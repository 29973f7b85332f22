"""Reading the input tables.

Text tables can arrive as a few big files (one row group each), which gives
one read partition per file.  Scoring is CPU-bound per row, so when the scan
yields fewer partitions than the cluster has cores we spread the rows out
once (round-robin, no key) before the heavy projection.  With many input
files this is a no-op and the scan partitions are used as they are.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from deckscope.session import default_parallelism

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, per_core: int = 4) -> DataFrame:
    """Repartition only when the scan gives fewer partitions than cores."""
    cores = default_parallelism(df.sparkSession)
    try:
        n = df.rdd.getNumPartitions()     # planning only, no job
    except Exception:  # noqa: BLE001 - sessions without RDD access: keep the scan partitions
        return df
    return df.repartition(cores * per_core) if n < cores else df
