"""Vector, keyword and hybrid search.

Queries are a table, so that many are answered in one plan; the queries' side is small by nature and is the one that
joins broadcast where it is small enough. Top-k lists are row_number() <= k, which Spark cuts before the shuffle.
Null and zero vectors and empty queries have no hits; ties go to the lesser id. Scores of keyword and hybrid searches tie
where they are equal to PLACES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from tessella.functions.text import words
from tessella.sources.lineage import ship

K1, B = 1.2, 0.75
#: Bytes of queries' vectors that go to all tasks at once; words of queries that are broadcast at most.
QUERY_BYTES, ASKED = 1 << 25, 1 << 18


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """df with vectors of length 1, the materialised form of a vector index; rows without a direction go."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(dot(v, v))
    return df.withColumn("_n", norm).filter("_n > 0").withColumn(vector, F.transform(v, lambda x: x / F.col("_n"))).drop("_n")


#: Decimal places that a score which is summed up counts to: sums differ in their last bits by the order of their terms.
PLACES = 9


def top(df: DataFrame, k: int, by: str = "query_id", score: str = "score", id: str = "id", places: int | None = None) -> DataFrame:
    """The k best of each query, with rank. Scores that are equal to so many places tie."""
    s = F.col(score) if places is None else F.round(score, places)
    w = Window.partitionBy(by).orderBy(F.desc(s), F.asc(id))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vector_search(index: DataFrame, queries: DataFrame, k: int = 10, id: str = "id", vector: str = "embedding") -> DataFrame:
    """query_id, id, score (cosine), rank; index and queries (query_id, vector) have unit vectors. Exact.

    Queries go in blocks of QUERY_BYTES; each block is a matrix that every task holds, so that the index is read in batches
    where it lies and a task passes on only the k best of each query. Vectors of another length than the query's don't count.
    """
    if k <= 0:
        raise ValueError("k has to be positive")
    spark = index.sparkSession
    ship(spark)
    kind, of = index.schema[id].dataType, queries.schema["query_id"].dataType
    q = queries.select("query_id", F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    total = q.agg(F.sum(F.size("v") * 8)).first()[0] or 0
    blocks = -(-total // QUERY_BYTES)
    x = index.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    schema = StructType().add("query", IntegerType()).add("id", kind).add("score", DoubleType())
    out = None
    for b in range(blocks):
        t = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks)) == b)).toArrow()
        size = pc.list_value_length(t.column("v")).to_numpy()
        by = {int(d): (np.flatnonzero(size == d), np.array(t.column("v").filter(pa.array(size == d)).combine_chunks().flatten()).reshape(-1, d)) for d in np.unique(size) if d}
        found = x.mapInArrow(lambda batches, by=by: _best(batches, by, k), schema)
        names = spark.createDataFrame(pa.table({"query": pa.array(np.arange(t.num_rows, dtype=np.int32)), "query_id": t.column("query_id")}), StructType().add("query", IntegerType()).add("query_id", of))
        part = found.join(F.broadcast(names), "query").select("query_id", "id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], StructType().add("query_id", of).add("id", kind).add("score", DoubleType()))
    return top(out, k)


def _best(batches: Iterator[pa.RecordBatch], by: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a partition for each query; ties go to the lesser id, so what ties with the k-th stays until then."""
    held: dict[int, tuple[list, np.ndarray]] = {}
    for batch in batches:
        size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for d, (numbers, matrix) in by.items():
            at = np.flatnonzero(size == d)
            if not len(at):
                continue
            rows = np.asarray(batch.column(1).take(pa.array(at)).flatten(), np.float64).reshape(-1, d)
            ids = batch.column(0).take(pa.array(at))
            for s in range(0, len(numbers), 256):
                scores = rows @ matrix[s : s + 256].T
                for c, n in enumerate(numbers[s : s + 256]):
                    own = scores[:, c]
                    least = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -np.inf
                    pick = np.flatnonzero(own >= least)
                    some, best = held.get(int(n), ([], np.zeros(0)))
                    some, best = some + ids.take(pa.array(pick)).to_pylist(), np.concatenate([best, own[pick]])
                    if len(best) > k:
                        order = sorted(range(len(best)), key=lambda i: (-best[i], some[i]))[:k]
                        some, best = [some[i] for i in order], best[order]
                    held[int(n)] = some, best
        kind = batch.schema.field(0).type
    if held:
        numbers = np.repeat(np.fromiter(held, np.int32, len(held)), [len(s) for s, _ in held.values()])
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([i for s, _ in held.values() for i in s], kind), pa.array(np.concatenate([b for _, b in held.values()]))], ["query", "id", "score"])


def postings(df: DataFrame, id: str = "id", text: str = "name") -> DataFrame:
    """The inverted index: term, id, tf, length."""
    return _tf(_each_word(df, id, text))


def _each_word(df: DataFrame, id: str, text: str) -> DataFrame:
    w = df.select(F.col(id).alias("id"), words(F.col(text)).alias("_w"))
    return w.select("id", F.size("_w").alias("length"), F.explode("_w").alias("term"))


def _tf(each: DataFrame) -> DataFrame:
    return each.groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def _terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))


def bm25(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, score, rank of queries (query_id, text) over a stored index; any of the words may match."""
    docs = index.groupBy("id").agg(F.first("length").alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    terms = _terms(queries)
    return _scored(index.join(terms.select("term").distinct(), "term", "left_semi"), terms, docs, k)


def bm25_texts(df: DataFrame, queries: DataFrame, k: int = 10, id: str = "id", text: str = "name") -> DataFrame:
    """The same over texts (ids are distinct): their figures come from one pass, and only words that are asked for leave their row."""
    length = df.select(F.size(words(F.col(text))).alias("length"))
    docs = length.filter("length > 0").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    terms = _terms(queries)
    asked = terms.select("term").distinct()
    if asked.count() <= ASKED:
        asked = F.broadcast(asked)
    return _scored(_tf(_each_word(df, id, text).join(asked, "term", "left_semi")), terms, docs, k)


def _scored(hits: DataFrame, terms: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    df_ = hits.groupBy("term").agg(F.count("*").alias("df"))
    x = hits.join(df_, "term").join(terms, "term").crossJoin(docs)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return top(x.groupBy("query_id", "id").agg(F.sum(idf * tf).alias("score")), k, places=PLACES)


def hybrid(vector: DataFrame, keyword: DataFrame, k: int = 10, ranker: str = "naive", alpha: float | None = None) -> DataFrame:
    """Both lists (query_id, id, score) by their scores over each list's greatest: query_id, id, score, rank.

    naive takes the greater, linear alpha * vector + (1 - alpha) * keyword. A list whose greatest score isn't positive
    counts as zeros; an id that occurs twice in a list counts with its greatest score."""
    if ranker not in ("naive", "linear") or k <= 0:
        raise ValueError("the ranker is naive or linear, k positive")
    if ranker == "linear" and (alpha is None or not 0 <= alpha <= 1):
        raise ValueError("linear needs an alpha from 0 to 1")

    def scaled(df: DataFrame, name: str) -> DataFrame:
        best = df.groupBy("query_id", F.col("id").cast("string").alias("id")).agg(F.max("score").alias("s"))
        most = F.max("s").over(Window.partitionBy("query_id"))
        return best.select("query_id", "id", F.when(most > 0, F.col("s") / most).otherwise(0.0).alias(name))

    x = scaled(vector, "v").join(scaled(keyword, "k"), ["query_id", "id"], "full_outer").fillna(0.0, ["v", "k"])
    score = F.greatest("v", "k") if ranker == "naive" else F.lit(alpha) * F.col("v") + (1 - F.lit(alpha)) * F.col("k")
    return top(x.select("query_id", "id", score.alias("score")), k, places=PLACES)
