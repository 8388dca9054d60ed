"""The corpus pipeline: documents of a known language, one of each group of near duplicates, without benchmark passages,
given their places in a mixture by target weights and placed in shards. Mixing leaves no document out.
Each stage takes what the one before kept; the last two add columns.

Defined cases: a document with a null or empty text has no language and goes in the first stage; one with a null id stays
where its text may, and is the last choice of a group of near duplicates; of repeated rows one stays; a null source is a
source of its own; very long texts are read whole; equal documents go by the least id; an empty table gives an empty result.
Other columns stay as they are, but for `mixture_slot`, `slot` and `shard`, which the last two stages replace. For the rest
see tessella.llm.langid, jaccard, decontam, mixing and sharding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, jaccard, langid, mixing, sharding
from tessella.llm.common import col, cut, fresh, read, without


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each with its place in op8_mixing's golden-ratio schedule, carried on until all sources are used up;
    sharding has a `slot` of its own, so it is `mixture_slot`.
    Columns of documents that mixing would replace are put aside and come back."""
    own = without(docs, "mixture_slot")
    aside = {c: name for c, name in zip(own.columns, fresh(own, *(f"_own_{c}" for c in own.columns)), strict=True) if c.lower() in ("slot", "block")}
    mixed = mixing.mix(own.select(*[col(c).alias(aside.get(c, c)) for c in own.columns]), exhaust=True)
    return mixed.select(*[col(aside.get(c, c)).alias(c) for c in own.columns], F.col("slot").alias("mixture_slot"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shards),
]

#: Language identification is a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is cut, so that later stages don't repeat earlier ones."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
