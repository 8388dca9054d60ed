"""Sources of documents and sinks of runs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.functions.text import document_id, text_hash


def _pages(df: DataFrame) -> Column:
    """Pages as structs of text and metadata, of an array of strings or of structs that have some of both."""
    to = "array<struct<text:string,metadata:map<string,string>>>"
    if "pages" not in df.columns:
        return F.lit(None).cast(to)
    of = df.schema["pages"].dataType.elementType
    names = of.fieldNames() if isinstance(of, StructType) else []
    none = F.lit(None).cast("map<string,string>")
    text = lambda p: p.cast("string") if not names else p["text"] if "text" in names else F.lit("")
    meta = lambda p: p["metadata"].cast("map<string,string>") if "metadata" in names else none
    return F.transform("pages", lambda p: F.struct(F.coalesce(text(p), F.lit("")).alias("text"), meta(p).alias("metadata")))


def envelopes(df: DataFrame) -> DataFrame:
    """Documents (document_id, text, text_hash, metadata, pages) of envelopes, which have either text or pages (an array
    of strings, or of structs with text and metadata; joined by blank lines) and metadata; an envelope with both or
    neither is an error. One row an envelope; envelopes of one source or text have the same document_id."""
    has = lambda c: F.col(c).isNotNull() if c in df.columns else F.lit(False)
    x = df.withColumn("_ok", F.assert_true(has("text") != has("pages"), F.lit("an envelope has either text or pages")))
    x = x.withColumn("_p", _pages(df))
    joined = F.array_join(F.transform("_p", lambda p: p["text"]), "\n\n")
    text = F.coalesce(F.col("text"), joined) if "text" in df.columns else joined
    none = F.create_map().cast("map<string,string>")
    meta = F.coalesce("metadata", none) if "metadata" in df.columns else none
    x = x.withColumns({"_t": text, "_m": meta}).filter("_ok is null")
    name = lambda k: F.try_element_at("_m", F.lit(k))
    return x.select(document_id(F.col("_t"), name("source"), name("title")).alias("document_id"), F.col("_t").alias("text"), text_hash(F.col("_t")).alias("text_hash"), F.col("_m").alias("metadata"), F.col("_p").alias("pages"))


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank ones are skipped."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def write_run(results: DataFrame, manifest: dict, path: str) -> None:
    """results as JSON lines and the manifest beside them."""
    spark = results.sparkSession
    results.write.mode("overwrite").json(f"{path}/results")
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
