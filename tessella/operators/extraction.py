"""Extraction: the schema's vocabulary, prompts, model calls, parsing of their answers, and the schema filter.

Models are objects with `invoke(prompt) -> str` (see tessella.models); they are called in Arrow batches and an error
becomes a row's `error`. Answers that don't parse give no items. All else is a plan in the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "struct<nodes:array<struct<id:string,label:string,properties:map<string,string>>>,relationships:array<struct<source_id:string,target_id:string,type:string,properties:map<string,string>>>>"
CLAIMS = "struct<claims:array<struct<subject:string,claim_type:string,description:string,status:string>>>"
TYPES = ("STRING", "INTEGER", "FLOAT", "BOOLEAN", "DATE", "DATETIME", "LIST")


@dataclass(frozen=True)
class NodeType:
    label: str
    description: str = ""
    properties: tuple[str, ...] = ()
    identity: str | None = None


@dataclass(frozen=True)
class Schema:
    """The labels, relationship types and patterns (source, type, target) that count; no patterns means that any ends do."""

    nodes: tuple[NodeType, ...]
    relationships: tuple[str, ...] = ()
    patterns: tuple[tuple[str, str, str], ...] = field(default=())

    def __post_init__(self) -> None:
        labels = [n.label for n in self.nodes]
        if len(set(labels)) != len(labels) or len(set(self.relationships)) != len(self.relationships):
            raise ValueError("labels and relationship types have to be distinct")
        for a, t, b in self.patterns:
            if a not in labels or b not in labels or t not in self.relationships:
                raise ValueError(f"a pattern names what the schema doesn't have: {a}, {t}, {b}")

    def labels(self, spark: SparkSession) -> DataFrame:
        rows = [(n.label, n.identity, sorted({*n.properties, "name", "description", "weight", "canonical_key"})) for n in self.nodes]
        return spark.createDataFrame(rows, "label string, identity string, allowed array<string>")

    def text(self) -> str:
        lines = [f"- {n.label}: {n.description} ({', '.join(n.properties)})" for n in self.nodes]
        return "\n".join([*lines, "Relationships: " + ", ".join(self.relationships), *(f"({a})-[{t}]->({b})" for a, t, b in self.patterns)])


def build_schema(nodes: list, relationships: list[str] = (), patterns: list = ()) -> Schema:
    """A schema of plain labels or dicts (label, description, properties, identity)."""
    made = [NodeType(n) if isinstance(n, str) else NodeType(n["label"], n.get("description", ""), tuple(n.get("properties", ())), n.get("identity")) for n in nodes]
    return Schema(tuple(made), tuple(relationships), tuple(tuple(p) for p in patterns))


@dataclass(frozen=True)
class Prompts:
    """Templates of what models are asked; names in braces are filled in, other braces stay."""

    extract: str = "Give the entities and relationships of the text as JSON with nodes and relationships.\n{schema}\n\nText:\n{text}"
    assess: str = "{prompt}\n\nFound: {found}\nIs anything missing? Answer yes or no."
    more: str = "{prompt}\n\nFound: {found}\nGive what is missing."
    claims: str = "Give the claims about these subjects as JSON with claims: {subjects}\n\nText:\n{text}"
    report: str = "Report on community {community} (level {level}).\n\n{context}\n\nIds that findings may refer to:\n{ids}\n\nAnswer as JSON with title, summary, rating, rating_explanation and findings."
    repair: str = "The report below can't be used: {problems}.\n\n{content}\n\nIds that findings may refer to:\n{ids}\n\nAnswer with the whole report again, as JSON with title, summary, rating, rating_explanation and findings."


def fill(template: str, **columns: Column) -> Column:
    """A template with columns in the place of their names in braces."""
    parts = re.split("(" + "|".join(re.escape("{" + k + "}") for k in columns) + ")", template)
    return F.concat(*[columns[p[1:-1]] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def extraction_prompt(schema: Schema, text: Column, prompts: Prompts = Prompts()) -> Column:
    return fill(prompts.extract, schema=F.lit(schema.text()), text=text)


def claims_prompt(subjects: Column, text: Column, prompts: Prompts = Prompts()) -> Column:
    return fill(prompts.claims, subjects=F.array_join(subjects, ", "), text=text)


def call(df: DataFrame, prompt: Column, model, into: str = "content") -> DataFrame:
    """df with the model's answer and `error`; null prompts aren't asked."""

    @F.arrow_udf("struct<content:string,error:string>")
    def ask(prompts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in prompts:
            out = []
            for p in batch.to_pylist():
                try:
                    out.append({"content": None if p is None else model.invoke(p), "error": None})
                except Exception as e:  # noqa: BLE001 - an error is data here: it is kept for the caller's policy
                    out.append({"content": None, "error": str(e) or type(e).__name__})
            yield pa.array(out, pa.struct([("content", pa.string()), ("error", pa.string())]))

    x = df.withColumn("_a", ask.asNondeterministic()(prompt))
    return x.withColumns({into: F.col("_a.content"), "error": F.col("_a.error")}).drop("_a")


def unfenced(content: Column) -> Column:
    """What a code fence holds, or all."""
    inner = F.regexp_extract(content, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(content.contains("```"), F.when(inner != "", inner).otherwise(content)).otherwise(content))


def parse_items(content: Column) -> Column:
    """nodes and relationships of an answer; items without ids, labels, ends or types go."""
    x = F.from_json(unfenced(content), ITEMS)
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    none = F.from_json(F.lit('{"nodes":[],"relationships":[]}'), ITEMS)
    nodes = F.filter(F.coalesce(x["nodes"], none["nodes"]), lambda n: full(n["id"]) & full(n["label"]))
    rels = F.filter(F.coalesce(x["relationships"], none["relationships"]), lambda r: full(r["source_id"]) & full(r["target_id"]) & full(r["type"]))
    return F.struct(nodes.alias("nodes"), rels.alias("relationships"))


def wants_more(content: str | None) -> bool:
    """Does the model want another round? A yes among its first 30 characters says so."""
    return "yes" in (content or "").strip().lower()[:30]


def parse_claims(content: Column, subjects: Column) -> Column:
    """Claims with a description about one of the subjects; types and states have defaults. A bare list is taken too."""
    x = unfenced(content)
    x = F.when(x.startswith("["), F.concat(F.lit('{"claims":'), x, F.lit("}"))).otherwise(x)
    found = F.coalesce(F.from_json(x, CLAIMS)["claims"], F.from_json(F.lit('{"claims":[]}'), CLAIMS)["claims"])
    ok = F.filter(found, lambda c: (F.coalesce(c["description"], F.lit("")) != "") & F.array_contains(subjects, c["subject"]))
    or_else = lambda v, d: F.coalesce(F.when(v != "", v), F.lit(d))
    return F.transform(ok, lambda c: F.struct(c["subject"].alias("subject"), or_else(c["claim_type"], "general").alias("claim_type"), c["description"].alias("description"), or_else(c["status"], "active").alias("status")))


class Gleaning:
    """A model that asks another whether it missed anything, and merges what it adds: new nodes and relationships only."""

    def __init__(self, model, rounds: int, prompts: Prompts = Prompts()):
        self.model, self.rounds, self.prompts = model, rounds, prompts

    @staticmethod
    def _parse(content: str) -> dict:
        m = re.search(r"```(?:json)?\s*(.*?)```", content, re.DOTALL)
        try:
            x = json.loads((m[1] if m else content).strip())
        except ValueError:
            x = {}
        return x if isinstance(x, dict) else {}

    def invoke(self, prompt: str) -> str:
        x = self._parse(self.model.invoke(prompt))
        nodes, rels = list(x.get("nodes") or []), list(x.get("relationships") or [])
        key = lambda r: (r.get("source_id"), r.get("type"), r.get("target_id"))
        for _ in range(self.rounds):
            ask = lambda t: self.model.invoke(t.replace("{found}", json.dumps({"nodes": nodes, "relationships": rels})).replace("{prompt}", prompt))
            if not wants_more(ask(self.prompts.assess)):
                break
            more = self._parse(ask(self.prompts.more))
            ids, keys, before = {n.get("id") for n in nodes}, {key(r) for r in rels}, len(nodes) + len(rels)
            for n in more.get("nodes") or []:
                if n.get("id") not in ids:
                    ids.add(n.get("id"))
                    nodes.append(n)
            for r in more.get("relationships") or []:
                if key(r) not in keys:
                    keys.add(key(r))
                    rels.append(r)
            if len(nodes) + len(rels) == before:
                break
        return json.dumps({"nodes": nodes, "relationships": rels})


def extract(chunks: DataFrame, schema: Schema, model, gleanings: int = 0, prompts: Prompts = Prompts()) -> DataFrame:
    """chunks with `nodes`, `relationships` and `error`; the answers are of one call a chunk, or of several with gleanings."""
    asked = call(chunks, extraction_prompt(schema, F.col("text"), prompts), Gleaning(model, gleanings, prompts) if gleanings else model)
    return asked.withColumn("_p", parse_items(F.col("content"))).select(*chunks.columns, F.col("_p.nodes").alias("nodes"), F.col("_p.relationships").alias("relationships"), "error")


def check_errors(extracted: DataFrame) -> int:
    """The number of chunks that failed; an error if all did."""
    r = extracted.agg(F.count("*").alias("n"), F.count("error").alias("bad"), F.first("error", True).alias("one")).first()
    if r["n"] and r["n"] == r["bad"]:
        raise RuntimeError(f"all {r['n']} chunks failed, one with: {r['one']}")
    return r["bad"]


def valid_nodes(extracted: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes with a label of the vocabulary (label, identity, allowed), a row each: chunk_id, pos, node_id, label,
    name, properties; properties that aren't allowed go, the name has a chain of fallbacks."""
    x = extracted.select("chunk_id", F.posexplode("nodes").alias("pos", "n")).select("chunk_id", "pos", F.col("n.id").alias("node_id"), F.col("n.label").alias("label"), F.coalesce("n.properties", F.create_map().cast("map<string,string>")).alias("p"))
    x = x.join(F.broadcast(labels), "label")  # a vocabulary: by a shuffle, all nodes of a label would meet in one task
    some = lambda c: F.when(c != "", c)
    name = F.coalesce(some(F.try_element_at("p", F.col("identity"))), some(F.try_element_at("p", F.lit("name"))), some(F.try_element_at("p", F.lit("title"))), F.col("node_id"))
    return x.select("chunk_id", "pos", "node_id", "label", name.alias("name"), F.coalesce(F.try_element_at("p", F.lit("description")), F.lit("")).alias("description"), F.map_filter("p", lambda k, v: F.array_contains(F.col("allowed"), k)).alias("properties"))


def valid_relationships(extracted: DataFrame, nodes: DataFrame, schema: Schema) -> DataFrame:
    """The relationships of known types whose ends are valid nodes of the same chunk in a pattern of the schema:
    chunk_id, pos, source_id, target_id, type, description, weight, properties."""
    spark = extracted.sparkSession
    x = extracted.select("chunk_id", F.posexplode("relationships").alias("pos", "r")).select("chunk_id", "pos", "r.source_id", "r.target_id", "r.type", F.coalesce("r.properties", F.create_map().cast("map<string,string>")).alias("properties"))
    x = x.filter(F.col("type").isin(*schema.relationships))
    n = nodes.groupBy("chunk_id", "node_id").agg(F.min_by("label", "pos").alias("label"))
    for end in ("source", "target"):
        x = x.join(n.select("chunk_id", F.col("node_id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label")), ["chunk_id", f"{end}_id"])
    if schema.patterns:
        p = spark.createDataFrame(list(schema.patterns), "source_label string, type string, target_label string")
        x = x.join(F.broadcast(p), ["source_label", "type", "target_label"], "left_semi")
    weight = F.coalesce(F.expr("try_cast(try_element_at(properties, 'weight') as double)"), F.lit(1.0))
    return x.select("chunk_id", "pos", "source_id", "target_id", "type", F.coalesce(F.try_element_at("properties", F.lit("description")), F.lit("")).alias("description"), weight.alias("weight"), "properties")
