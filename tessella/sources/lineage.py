"""Cutting of lineage in the folder that all executors share, and the package for workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A temporary one of our own only where there is one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext.getCheckpointDir() is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="tessella-"))
    return at or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in the shared folder, so that it is computed once and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_bare(df: DataFrame) -> DataFrame:
    """The same without what the optimizer knows of df: over many rounds the constraints it infers of aliases double in each."""
    spark, out = df.sparkSession, cut(df)
    rows = out._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, out._jdf.schema(), False), spark)


def numbered(df: DataFrame, order: list[str | Column], name: str, start: int = 1) -> DataFrame:
    """df with the number of each row in an order of all rows, from start on. A window without keys would sort all in one
    task; here partitions are ranges of the order, and each adds the rows before it."""
    x = cut(df.sort(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    counts, before, rows = sorted(map(tuple, x.groupBy(part.alias("p")).count().collect())), start, []
    for p, n in counts:
        rows.append((p, before))
        before += n
    base = df.sparkSession.createDataFrame(rows, "_part bigint, _base bigint")
    return x.join(F.broadcast(base), part == F.col("_part")).withColumn(name, F.col(name) - F.shiftleft("_part", 33) + F.col("_base")).drop("_part", "_base")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: by path on the driver's machine, as a zip that Spark hands out elsewhere."""
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(PACKAGE.parent) in paths:
        return
    if not sc.master.startswith("local["):
        at = os.path.join(sc._temp_dir, f"{PACKAGE.name}.zip")
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(PACKAGE.parent))
        sc.addPyFile(at)
    sc.environment["PYTHONPATH"] = os.pathsep.join([str(PACKAGE.parent), *paths])
