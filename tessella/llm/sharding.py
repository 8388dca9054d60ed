"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table: it starts at an offset and goes on in steps
of a skip, both taken from the MD5 of its name. The shards take turns; at its turn a shard claims the first slot of
its permutation that nobody has claimed. The slots of two shards differ by one at most, and when a shard goes,
nearly all slots of the others stay. The filled table has a fixed size, is broadcast, and a document's shard is one
lookup by its hashed key: no shuffle, no Python.

Defined cases: a null key counts as the empty string; equal keys get equal shards, whatever their texts; an empty table gives an empty
result; input columns named like an output column (`slot`, `shard`) are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import col, fresh, hash_duck, hash_sql, without

SHARDS = 16
#: A prime over 100 times the number of shards, so that no shard is over 1 % larger than another.
TABLE_SIZE = 2039


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def preferences(name: str, size: int) -> tuple[int, int]:
    """Offset and skip of a shard's permutation."""
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    return h(name + "|offset") % size, h(name + "|skip") % (size - 1) + 1


def fill(names: list[str], size: int) -> np.ndarray:
    """The table: for each slot the position in names of the shard that claimed it."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need distinct names, one at least")
    if not _is_prime(size) or size < len(names):
        raise ValueError("the table's size has to be a prime, no smaller than the number of shards")
    table = np.full(size, -1, np.int32)
    walk = [preferences(n, size) for n in names]
    at = [0] * len(names)
    for turn in range(size):
        i = turn % len(names)
        offset, skip = walk[i]
        while table[slot := (offset + at[i] * skip) % size] >= 0:
            at[i] += 1
        table[slot] = i
    return table


def assign(df: DataFrame, key: str = "doc_id", shards: int | list[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """df with `slot` BIGINT and `shard` INT, the position of the shard among the names."""
    names = shard_names(shards) if isinstance(shards, int) else shards
    spark = df.sparkSession
    table = fill(names, size)
    look = spark.createDataFrame([(i, int(s)) for i, s in enumerate(table)], "slot bigint, shard int")
    (k,) = fresh(df, "_key")
    rows = df.withColumn(k, F.coalesce(col(key).cast("string"), F.lit("")))
    rows = without(rows, "slot", "shard").withColumn("slot", F.expr(f"{hash_sql(k)} % {size}")).drop(k)
    kept = [col(c) for c in rows.columns]
    return rows.join(F.broadcast(look), "slot").select(*kept, "shard")


def write(df: DataFrame, path: str, **options) -> None:
    """assign(), and one folder per shard under path; rows go straight from the scan to their shard's file."""
    assign(df, **options).write.mode("overwrite").partitionBy("shard").parquet(path)


def oracle(table: str = "documents", columns: str = "doc_id, lang, source, n_chars, text", n: int = SHARDS, size: int = TABLE_SIZE) -> str:
    """DuckDB SQL for assign() over a table: the turns are a recursion, its state the list of slot owners."""
    return f"""
WITH RECURSIVE shards AS (
  SELECT i AS shard, {hash_duck("name || '|offset'")} % {size} AS o, {hash_duck("name || '|skip'")} % {size - 1} + 1 AS s
  FROM (SELECT i, 'shard-' || lpad(i::VARCHAR, 5, '0') AS name FROM range({n}) t(i))
), walk AS (
  SELECT list(list_transform(range({size}), lambda j: (o + j * s) % {size}) ORDER BY shard) AS prefer FROM shards
), turns AS (
  SELECT 0::BIGINT AS turn, list_transform(range({size}), lambda x: (-1)::BIGINT) AS owner FROM range(1)
  UNION ALL
  SELECT turn + 1, owner[:slot] || [turn % {n}] || owner[slot + 2:]
  FROM (SELECT turn, owner, list_filter(prefer[turn % {n} + 1], lambda z: owner[z + 1] < 0)[1] AS slot
        FROM turns, walk WHERE turn < {size})
), look AS (
  SELECT unnest(range({size})) AS slot, unnest(owner)::INTEGER AS shard FROM turns WHERE turn = {size}
)
SELECT d.*, look.shard FROM (
  SELECT {columns}, {hash_duck("coalesce(doc_id::VARCHAR, '')")} % {size} AS slot FROM {table}
) d JOIN look USING (slot)"""
