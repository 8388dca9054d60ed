"""Global search: reports in batches, an answer for each, and the answers put together.

Reports of a level are few next to the graph, but batching still runs as a fold in the JVM, one group a level.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from tessella.functions.text import token_count
from tessella.operators.context import REFERENCE_TYPES
from tessella.sources.lineage import numbered

MAP_PROMPT = "Answer the question from the reports, as JSON with answer, helpfulness (0 to 100), report_ids and references.\n\nQuestion: {query}\n\nReports:\n{text}"
REDUCE_PROMPT = "Put the partial answers together.\n\nQuestion: {query}\n\nPartial answers:\n{text}"
REFUSAL = "Global search needs one community level."
_REFERENCE = StructType().add("target_type", StringType()).add("target_id", StringType())
PARSED = StructType().add("answer", StringType()).add("helpfulness", IntegerType()).add("report_ids", ArrayType(StringType())).add("references", ArrayType(_REFERENCE)).add("bad", StringType())


def read_reports(communities: DataFrame, level: int | None = None) -> DataFrame:
    """id, level, summary of the reports that didn't fail and aren't empty."""
    text = F.coalesce("report_text", "summary") if "report_text" in communities.columns else F.col("summary")
    x = communities.withColumn("_t", text).filter("coalesce(_t, '') != ''")
    if "report_status" in x.columns:
        x = x.filter("coalesce(report_status, 'success') != 'failed'")
    if level is not None:
        x = x.filter(F.col("level") == level)
    return x.select("id", "level", F.col("_t").alias("summary"))


def shuffled(ids: list[str], seed: int | None = 42) -> dict[str, int]:
    """Places of ids after a reproducible shuffle of their order."""
    order = sorted(ids)
    random.Random(seed).shuffle(order)
    return {x: i for i, x in enumerate(order)}


def batches(reports: DataFrame, available: int, order: str = "id") -> DataFrame:
    """level, batch_id, report_ids, text, tokens: reports in order, a batch closed where the next one doesn't fit; one
    that is larger than the budget stands alone."""
    text = F.concat(F.lit("Report "), F.col("id").cast("string"), F.lit(":\n"), "summary")
    rows = reports.withColumn("_text", text).withColumn("_n", token_count(F.col("_text")).cast("bigint"))
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_n").alias("n"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(-1).alias("batch"), F.array().cast("array<int>").alias("of"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["batch"] < 0) | (acc["used"] + x["n"] > available)
        batch = F.when(new, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct((F.when(new, F.lit(0)).otherwise(acc["used"]) + x["n"]).alias("used"), batch.alias("batch"), F.concat(acc["of"], F.array(batch)).alias("of"))

    folded = rows.groupBy("level").agg(each.alias("x")).select("level", F.explode(F.arrays_zip("x", F.aggregate("x", start, step)["of"].alias("b"))).alias("z"))
    where = folded.select("level", F.col("z.x.o").alias(order), F.col("z.b").alias("batch_id"))
    joined = rows.join(where, ["level", order])
    got = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("id"), F.col("_text").alias("t"))))
    x = joined.groupBy("level", "batch_id").agg(got.alias("g"), F.sum("_n").alias("tokens"))
    return x.select("level", "batch_id", F.transform("g", lambda r: r["id"].cast("string")).alias("report_ids"), F.array_join(F.transform("g", lambda r: r["t"]), "\n\n").alias("text"), "tokens")


def parse_map(content: str) -> dict:
    """The JSON object of a map answer, out of fences or prose; helpfulness 0 where it isn't a number from 0 to 100."""
    m = re.search(r"```(?:json)?\s*(.*?)```", content, re.DOTALL)
    body = (m[1] if m else content).strip()
    try:
        found = json.loads(body)
    except ValueError:
        found, at = None, body.find("{")
        while at >= 0 and not isinstance(found, dict):
            try:
                found = json.JSONDecoder().raw_decode(body, at)[0]
            except ValueError:
                pass
            at = body.find("{", at + 1)
    if not isinstance(found, dict):
        raise ValueError("no JSON object in the answer")
    try:
        score = float(found.get("helpfulness", 0))
    except (TypeError, ValueError):
        score = 0.0
    refs = [{"target_type": str(r.get("target_type", "")).strip(), "target_id": str(r.get("target_id", "")).strip()} for r in found.get("references") or [] if isinstance(r, dict)]
    ids = found.get("report_ids")
    return {
        "answer": str(found.get("answer", "")),
        "helpfulness": int(score) if 0 <= score <= 100 else 0,
        "report_ids": [str(x) for x in ids] if isinstance(ids, list) else None,
        "references": [r for r in refs if r["target_id"] and r["target_type"] in REFERENCE_TYPES],
    }


@F.pandas_udf(PARSED)
def parse_map_udf(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in contents:
        out = []
        for c in batch:
            try:
                out.append({**parse_map(c), "bad": None} if c is not None else {"answer": "", "helpfulness": 0, "report_ids": None, "references": [], "bad": "no answer"})
            except ValueError as e:
                out.append({"answer": "", "helpfulness": 0, "report_ids": None, "references": [], "bad": str(e)})
        yield pd.DataFrame(out)


def map_phase(made: DataFrame, query: str, model, concurrency: int = 5) -> DataFrame:
    """batches with answer, helpfulness, report_ids (of the answer), references, batch_report_ids and error."""
    from tessella.operators.extraction import call

    head, tail = MAP_PROMPT.replace("{query}", query.replace("{", "{{")).split("{text}")
    asked = call(made.repartition(concurrency, "batch_id"), F.concat(F.lit(head), "text", F.lit(tail)), model)
    x = asked.withColumn("_p", parse_map_udf("content"))
    return x.select("level", F.col("batch_id").cast("string").alias("batch_id"), "_p.answer", "_p.helpfulness", F.coalesce("_p.report_ids", "report_ids").alias("report_ids"), "_p.references", F.col("report_ids").alias("batch_report_ids"), F.coalesce("error", "_p.bad").alias("error"))


def scored(partials: DataFrame, most: int | None = None) -> DataFrame:
    """Partial answers without errors and with some help, the most helpful first, with `place`."""
    x = numbered(partials.filter("error is null and helpfulness > 0"), [F.desc("helpfulness"), "batch_id"], "place").withColumn("place", F.col("place").cast("int"))
    return x if most is None else x.filter(F.col("place") <= most)


def used_reports(partials: DataFrame) -> DataFrame:
    """report_id, place: those the answers name among their batch's own, or all of the batch; each once, in order."""
    named = F.array_intersect("report_ids", "batch_report_ids")
    ids = F.when(F.size(named) > 0, named).otherwise(F.array_distinct("batch_report_ids"))
    x = partials.select("place", F.posexplode(ids).alias("pos", "report_id"))
    # An answer names a report once, so its place tells which is the first; numbers add up before the shuffle.
    return x.groupBy("report_id").agg(F.min("place").alias("place"), F.min_by("pos", "place").alias("pos"))


def reduce_texts(partials: DataFrame, available: int) -> DataFrame:
    """place, text, tokens of the partial answers up to the first that doesn't fit any more; the first always counts."""
    refs = F.array_join(F.transform("references", lambda r: F.concat(r["target_type"], F.lit(":"), r["target_id"])), ", ")
    text = F.concat(F.lit("[Score "), F.col("helpfulness").cast("string"), F.lit("] "), "answer", F.when(refs != "", F.concat(F.lit("\nReferences: "), refs)).otherwise(""))
    # A text has a token at least, so none beyond these places can fit; they are few enough for one task.
    x = partials.filter(F.col("place") <= max(1, available)).select("place", text.alias("text")).withColumn("tokens", token_count(F.col("text")))
    total = F.sum("tokens").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("total", total).filter((F.col("total") <= available) | (F.col("place") == 1)).drop("total")


def all_references(explicit: DataFrame, reported: DataFrame) -> DataFrame:
    """References (target_type, target_id, place) of answers, then of reports, each once in order, with `pos`."""
    x = explicit.withColumn("src", F.lit(0)).unionByName(reported.withColumn("src", F.lit(1)))
    x = x.filter(F.col("target_type").isin(*REFERENCE_TYPES)).groupBy("target_type", "target_id").agg(F.min("src").alias("src"), F.min_by("place", (F.col("src") * F.lit(1 << 40) + F.col("place"))).alias("place"))
    return numbered(x, ["src", "place", "target_type", "target_id"], "pos").select(F.col("pos").cast("int").alias("pos"), "target_type", "target_id")
