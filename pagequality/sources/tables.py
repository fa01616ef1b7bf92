"""Readers for the input tables.

A scan moves nothing by itself, but where an input has fewer splits than the cluster has cores (a small table in one
file), its wide rows are dealt out once, so that work on texts and markup doesn't wait for one task.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


class Views(str):
    """A table folder of which some tables are seen through a function."""

    views: dict = {}

    @classmethod
    def of(cls, sf_dir: str, **views) -> Views:
        out = cls(sf_dir)
        out.views = views
        return out


#: Wide columns, on which all the work is.
WIDE = {"documents": ("doc_id", "text"), "pages": ("page_id", "html")}


def dealt_out(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores if its scan has fewer splits than cores; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """Scan one table; ``columns`` prunes the scan."""
    df = spark.read.parquet(table_path(sf_dir, name))
    view = sf_dir.views.get(name) if isinstance(sf_dir, Views) else None
    if columns and view is None:
        df = df.select(*columns)
    key, wide = WIDE.get(name, (None, None))
    if wide in df.columns and key in df.columns:
        df = dealt_out(df, key)
    if view is not None:
        df = view(df)
    return df.select(*columns) if columns else df
