"""The graph store: tables of a property graph as Parquet, with upserts, views, checks and indexes.

An upsert reads a table, lays the new rows over it by key and swaps the folder it wrote for the old one: the old one is
set aside first, and taken back if what follows didn't happen. Tables are partitioned by nothing: a store of many graphs
filters by graph_name, which reaches the scan. Indexes of entities go when entities change, so none is out of date.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessella.sources.lineage import cut

KEYS = {
    "documents": ["graph_name", "id"], "chunks": ["graph_name", "id"], "entities": ["graph_name", "id"],
    "relationships": ["graph_name", "source_id", "target_id", "type"], "evidence": ["graph_name", "chunk_id", "entity_id"],
    "claims": ["graph_name", "id"], "communities": ["graph_name", "level", "id"], "memberships": ["graph_name", "entity_id", "community_id", "level"],
    "parents": ["graph_name", "child_id", "child_level", "parent_id", "parent_level"],
}


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with new laid over it by keys. Of several new rows of a key the greatest by order counts, or by all columns.
    A map `metadata` is merged, new entries first; `created` keeps its least value. Columns of either side stay."""
    both = new.withColumn("_seq", F.lit(1)) if old is None else old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_seq")]
    if not rest:
        return both.select(*keys).distinct()
    maps = {c for c, t in both.dtypes if t.startswith("map")}
    tie = [order] if order else [c for c in rest if c not in maps]
    at = F.struct("_seq", *tie)
    out = [F.min("created") if c == "created" else _merged(c, at) if c in maps else F.max_by(c, at) for c in rest]
    return both.groupBy(*keys).agg(*[x.alias(c) for x, c in zip(out, rest, strict=True)])


def _merged(c: str, at):
    """Maps laid over each other in order."""
    each = F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.map_entries(c).alias("m"))))), lambda x: x["m"])
    none = F.create_map().cast("map<string,string>")
    return F.aggregate(each, none, lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, v: ~F.exists(m, lambda e: e["key"] == k)), F.map_from_entries(m)))


def only_known(kind: str, rows: DataFrame, tables: Callable[[str], DataFrame | None]) -> DataFrame:
    """Rows whose ends exist: chunks need their document, evidence and relationships both ends, claims their entity."""
    known = lambda name, key: tables(name).select("graph_name", F.col("id").alias(key))
    need = {"chunks": [("documents", "document_id")], "evidence": [("chunks", "chunk_id"), ("entities", "entity_id")], "relationships": [("entities", "source_id"), ("entities", "target_id")], "claims": [("entities", "entity_id")]}
    for table, key in need.get(kind, []):
        rows = rows.join(known(table, key), ["graph_name", key], "left_semi")
    return rows


def type_counts(rows: DataFrame, kind: str) -> DataFrame:
    """kind, type, n: how many rows there are of each type."""
    return rows.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")


class GraphStore:
    ORDER = ("documents", "chunks", "entities", "evidence", "relationships", "claims", "communities", "memberships", "parents")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(f"{self.path}/{name}")
        if fs.exists(p):
            return True
        aside = self._fs(f"{self.path}/_{name}_aside")[1]
        return fs.exists(aside) and fs.rename(aside, p)

    def table(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{name}") if self.exists(name) else None

    def replace(self, name: str, df: DataFrame) -> None:
        """The table becomes df, which may read it."""
        new = f"{self.path}/_{name}_{time.time_ns()}"
        df.write.parquet(new)
        fs, p = self._fs(f"{self.path}/{name}")
        aside = self._fs(f"{self.path}/_{name}_aside")[1]
        if self.exists(name):
            fs.delete(aside, True)
            if not fs.rename(p, aside):
                raise RuntimeError(f"{name} can't be set aside")
        if not fs.rename(self._fs(new)[1], p):
            raise RuntimeError(f"{name} can't be put in its place")
        fs.delete(aside, True)
        self.spark.catalog.refreshByPath(f"{self.path}/{name}")
        if name == "entities":
            self.drop_indexes()

    def write(self, tables: dict[str, DataFrame]) -> dict[str, int]:
        """Upserts tables in the order of their dependence; the rows of each that were laid in."""
        stats = {}
        for name in self.ORDER:
            if name in tables:
                rows = cut(only_known(name, tables[name], self.table))  # laid in and counted
                self.replace(name, upsert(self.table(name), rows, KEYS[name]))
                stats[name] = rows.select(*KEYS[name]).distinct().count()
        return stats

    def sql(self, query: str, **args) -> DataFrame:
        """Spark SQL over views of the tables."""
        for name in self.ORDER:
            if self.exists(name):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(query, args=args or None)

    def duplicates(self, name: str) -> DataFrame:
        """Keys that occur more than once: none if the table is sound."""
        return self.table(name).groupBy(*KEYS[name]).count().filter("count > 1")

    def verify(self, graph: str, k: int = 20) -> DataFrame:
        """The k most frequent types of entities and of relationships: kind, type, n."""
        out = self.spark.createDataFrame([], "kind string, type string, n bigint")
        for t in ("entities", "relationships"):
            if self.exists(t):
                own = self.table(t).filter(F.col("graph_name") == graph)
                out = out.unionByName(type_counts(own, t).orderBy(F.desc("n"), "type").limit(k))
        return out

    def delete_communities(self, graph: str) -> None:
        for name in ("communities", "memberships", "parents"):
            if self.exists(name):
                self.replace(name, self.table(name).filter(F.col("graph_name") != graph))

    def upsert_vectors(self, vectors: DataFrame) -> None:
        """Lays vectors (graph_name, id, embedding) over the entities' own; all have to have one length, the old ones too."""
        old = self.table("entities")
        vectors = cut(vectors)
        sizes = vectors.select(F.size("embedding").alias("n"))
        if "embedding" in old.columns:
            sizes = sizes.union(old.join(vectors.select("graph_name", "id"), ["graph_name", "id"], "left_anti").filter("embedding is not null").select(F.size("embedding")))
        found = sorted(r.n for r in sizes.distinct().limit(3).collect())
        if len(found) > 1:
            raise ValueError(f"vectors of several lengths: {', '.join(map(str, found))}")
        new = vectors.select("graph_name", "id", F.col("embedding").alias("_v"))
        joined = old.join(new, ["graph_name", "id"], "left")
        had = F.col("embedding") if "embedding" in old.columns else F.lit(None).cast("array<float>")
        self.replace("entities", joined.withColumn("embedding", F.coalesce(F.col("_v"), had)).drop("_v"))

    def unembedded(self, graph: str) -> DataFrame:
        e = self.table("entities").filter(F.col("graph_name") == graph)
        return e.filter("embedding is null") if "embedding" in e.columns else e

    def create_indexes(self) -> None:
        """Materialises the keyword and vector indexes of the entities, of all graphs."""
        from tessella.operators.search import postings, unit_vectors

        e = self.table("entities")
        names = e.select(F.struct("graph_name", "id").alias("id"), "name")
        self.replace("index_names", postings(names).select(F.col("id.graph_name").alias("graph_name"), F.col("id.id").alias("id"), "term", "tf", "length"))
        if "embedding" in e.columns:
            self.replace("index_vectors", unit_vectors(e.select("graph_name", "id", "type", "embedding")))

    def drop_indexes(self) -> None:
        for name in ("index_names", "index_vectors"):
            fs, p = self._fs(f"{self.path}/{name}")
            fs.delete(p, True)


def save_artifact(tables: dict[str, DataFrame], path: str) -> None:
    """A graph document as JSON lines, a folder a table; claims are kept."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def load_artifact(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    out = {}
    for name, schema in schemas.items():
        try:
            out[name] = spark.read.schema(schema).json(f"{path}/{name}")
        except AnalysisException:
            continue
    return out
