"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.lineage import cut, shared_dir, ship

__all__ = ["col", "cut", "fresh", "hash_duck", "hash_sql", "lean", "partitions", "read", "shared_dir", "ship", "tidy", "without"]

_last = 0.0


def tidy(pause: float = 0.0) -> None:
    """Give back to the system what a worker has freed, which allocators keep for themselves; not again within a pause.
    Workers outlive their tasks, and what one stage left would count beside the next one's need."""
    global _last
    now = time.monotonic()
    if now - _last < pause:
        return
    _last = now
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not a C library that has it
        return


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that leaves its worker tidy."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            tidy()

    return tidied


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones which no column of df has, in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names (case ignored), which an operator is about to add."""
    low = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in low])


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sql(key: str) -> str:
    """Spark SQL for the first 32 bits of the MD5 of a string expression, as a BIGINT."""
    return f"cast(conv(substr(md5({key}), 1, 8), 16, 10) as bigint)"


def hash_duck(key: str) -> str:
    """The same for DuckDB."""
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
