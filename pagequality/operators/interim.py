"""Written intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

#: (table, path) of what the innermost ``passing`` has seen written.
_inside: ContextVar[list[tuple[DataFrame, str]] | None] = ContextVar("inside", default=None)


def _place(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, removed when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, hadoop = _place(spark, path)
    fs.deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` as a Parquet table, read back: cuts the lineage, and rows and their numbers stay as they are whatever
    executor is lost.  ``options`` go to the writer."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    inside = _inside.get()
    if inside is not None:
        inside.append((out, path))
    return out


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at its end, so frames made of them can't be used beyond it.

    A written table given to the function that this yields stays, until a ``passing`` around this one ends."""
    outer, inside, stay = _inside.get(), [], []
    token = _inside.set(inside)

    def keep(table: DataFrame) -> DataFrame:
        stay.append(table)
        return table

    try:
        yield keep
    finally:
        _inside.reset(token)
        for table, path in inside:
            if any(table is x for x in stay):
                if outer is not None:
                    outer.append((table, path))
            else:
                fs, hadoop = _place(table.sparkSession, path)
                fs.delete(hadoop, True)
                fs.cancelDeleteOnExit(hadoop)
