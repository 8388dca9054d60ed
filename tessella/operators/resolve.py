"""Entity resolution: groups of entities that are one, and the merge of their tables.

Entities are rows (graph_name, id, type, name). Groups never cross graphs or types. Entities without a name take no
part. The order of a group, and of candidates, is that of ids.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import indel_ratio, indel_scores, normalize_name
from tessella.operators.extraction import call, unfenced
from tessella.operators.search import dot
from tessella.sources.lineage import cut, ship

STRATEGIES = ("exact", "normalized", "fuzzy", "hybrid")
KEY = ["graph_name", "type"]


def _named(entities: DataFrame, unicode: bool = False) -> DataFrame:
    return entities.filter("name is not null").select(*KEY, "id", "name").withColumn("norm", normalize_name(F.col("name"), unicode))


def groups(entities: DataFrame, normalized: bool = False, unicode: bool = False) -> DataFrame:
    """graph_name, type, key, ids (sorted) of the entities with equal (normalised) names, where there are several."""
    by = "norm" if normalized else "name"
    x = (_named(entities, unicode) if normalized else entities.filter("name is not null")).groupBy(*KEY, F.col(by).alias("key"))
    return x.agg(F.array_sort(F.collect_set("id")).alias("ids")).filter("size(ids) > 1")


def singletons(entities: DataFrame, unicode: bool = False) -> DataFrame:
    """Entities whose normalised name nobody shares."""
    x = _named(entities, unicode)
    n = x.groupBy(*KEY, "norm").agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return x.join(n, [*KEY, "norm"], "left_semi")


def candidates(entities: DataFrame, k: int = 20, unicode: bool = False) -> DataFrame:
    """Each singleton's first k others, by id, that begin with the same character and are of like length:
    graph_name, type, id_a, id_b, norm_a, norm_b.

    The block of a first character may be all there is, so it is never joined with itself. A singleton asks each length
    that it admits for the ids around its own: its place among them is a running count, and the ranks it wants are
    equal keys. Of these at most k per length the first k count.
    """
    x = singletons(entities, unicode).withColumn("first", F.substring("norm", 1, 1)).withColumn("len", F.length("norm"))
    block = [*KEY, "first"]
    rank = F.row_number().over(Window.partitionBy(*block, "len").orderBy("id"))
    members = x.select(*block, "len", "id", "norm", rank.alias("rank"))
    lengths = members.select(*block, F.col("len").alias("len_b")).distinct()
    # The first k others: all ids from the least on, so the wanted ranks are 1 to k + 1, less one's own.
    asks = members.join(lengths, block).filter("abs(len - len_b) <= greatest(3, cast(least(len, len_b) * 0.4 as int))")
    asks = asks.select(*block, "len_b", F.col("id").alias("id_a"), F.col("norm").alias("norm_a"))
    heads = members.filter(F.col("rank") <= k + 1).select(*block, F.col("len").alias("len_b"), F.col("id").alias("id_b"), F.col("norm").alias("norm_b"))
    heads = heads.groupBy(*block, "len_b").agg(F.array_sort(F.collect_list(F.struct("id_b", "norm_b"))).alias("heads"))
    x = asks.join(heads, [*block, "len_b"]).groupBy(*block, "id_a", "norm_a").agg(F.flatten(F.collect_list("heads")).alias("heads"))
    mine = F.slice(F.array_sort(F.filter("heads", lambda h: h["id_b"] != F.col("id_a"))), 1, k)
    return x.select(*KEY, "id_a", "norm_a", F.explode(mine).alias("h")).select(*KEY, "id_a", "h.id_b", "norm_a", "h.norm_b")


def scores(pairs: DataFrame) -> DataFrame:
    """Pairs (norm_a, norm_b) with `score`, 0 to 100."""
    return pairs.withColumn("score", indel_ratio(F.col("norm_a"), F.col("norm_b")))


#: Names of a block that are looked through at once.
AHEAD = 1024


def fuzzy(entities: DataFrame, merge_threshold: float = 95.0, review_threshold: float = 85.0, k: int = 20, unicode: bool = False) -> DataFrame:
    """graph_name, type, id_a, id_b, score, decision (merge, review) of singletons, paired greedily in the order of ids.

    An entity takes the first of its k free candidates that reaches a threshold; merged ones are free no more. That is
    a walk in order, so each block (graph, type, first character) is one task; names of a block stay in one.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, norms = pdf["id"].tolist(), pdf["norm"].tolist()
        size = np.fromiter(map(len, norms), np.int64, len(norms))
        free, seen, out = np.ones(len(ids), np.bool_), set(), []
        for i in range(len(ids)):
            if not free[i]:
                continue
            # The first k free ones of like length, looked for from the front.
            near, a = np.zeros(0, np.int64), 0
            while len(near) < k and a < len(ids):
                n = size[a : a + AHEAD]
                ok = free[a : a + AHEAD] & (np.abs(n - size[i]) <= np.maximum(3, (np.minimum(n, size[i]) * 0.4).astype(np.int64)))
                found = np.flatnonzero(ok) + a
                near, a = np.concatenate([near, found[found != i]])[:k], a + AHEAD
            near = [int(j) for j in near if (min(i, j), max(i, j)) not in seen]
            score = indel_scores([norms[i]] * len(near), [norms[j] for j in near])
            reach = np.flatnonzero(score >= review_threshold)
            if len(reach):
                j, s = near[reach[0]], float(score[reach[0]])
                merge = s >= merge_threshold
                out.append((ids[i], ids[j], round(s, 2), "merge" if merge else "review"))
                seen.add((min(i, j), max(i, j)))
                if merge:
                    free[[i, j]] = False
        res = pd.DataFrame(out, columns=["id_a", "id_b", "score", "decision"])
        for c in KEY:
            res[c] = pdf[c].iloc[0]
        return res[[*KEY, "id_a", "id_b", "score", "decision"]]

    ship(entities.sparkSession)
    x = singletons(entities, unicode).withColumn("first", F.substring("norm", 1, 1))
    return x.groupBy(*KEY, "first").applyInPandas(walk, "graph_name string, type string, id_a string, id_b string, score double, decision string")


def alias_pairs(entities: DataFrame, aliases: DataFrame, unicode: bool = False) -> DataFrame:
    """graph_name, type, id_a (the canonical name's), id_b of entities that aliases (domain or null, canonical, alias)
    tie; each canonical entity takes the first alias by id, and each alias entity goes to the first that takes it."""
    x = _named(entities, unicode)
    a = aliases.select("domain", normalize_name(F.col("canonical"), unicode).alias("norm_a"), normalize_name(F.col("alias"), unicode).alias("norm_b")).distinct()
    left = x.select(*KEY, F.col("id").alias("id_a"), F.col("norm").alias("norm_a")).join(a, "norm_a").filter("domain is null or domain = type")
    pairs = left.join(x.select(*KEY, F.col("id").alias("id_b"), F.col("norm").alias("norm_b")), [*KEY, "norm_b"]).filter("id_a != id_b")
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy(*KEY, "id_a").orderBy("id_b"))).filter("r = 1")
    pairs = pairs.withColumn("q", F.row_number().over(Window.partitionBy(*KEY, "id_b").orderBy("id_a"))).filter("q = 1").select(*KEY, "id_a", "id_b")
    # One that is taken as an alias takes nobody itself.
    return pairs.join(pairs.select(*KEY, F.col("id_b").alias("id_a")), [*KEY, "id_a"], "left_anti")


def conflicts(found: DataFrame, entities: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """Groups (graph_name, type, key, ids) with `decision`: blocked where two members differ in a property that the rules
    of their type, or of `*`, name; else merge. Null and empty values and case and spaces don't count."""
    member = found.select(*KEY, "key", F.explode("ids").alias("id"))
    each = None
    for kind, names in rules.items():
        for p in names:
            v = F.regexp_replace(F.trim(F.lower(F.col(p).cast("string"))), r"\s+", " ")
            x = (entities if kind in ("*", "__default__") else entities.filter(F.col("type") == kind)).select("graph_name", "type", "id", F.lit(p).alias("p"), v.alias("v")).filter("v != ''")
            each = x if each is None else each.unionByName(x)
    if each is None:
        return found.withColumn("decision", F.lit("merge"))
    bad = member.join(each, [*KEY, "id"]).groupBy(*KEY, "key", "p").agg(F.countDistinct("v").alias("n")).filter("n > 1").select(*KEY, "key").distinct()
    return found.join(bad.withColumn("_bad", F.lit(True)), [*KEY, "key"], "left").withColumn("decision", F.when(F.col("_bad"), "blocked").otherwise("merge")).drop("_bad")


def mapping(found: DataFrame, entities: DataFrame) -> DataFrame:
    """old_id -> canonical_id for groups (ids); the canonical one has the longest name, the least id among those."""
    x = found.select(F.col("ids")[0].alias("g"), F.explode("ids").alias("id")).join(entities.select("id", "name"), "id")
    best = F.min(F.struct((-F.length("name")).alias("l"), "id")).over(Window.partitionBy("g"))
    return x.select(F.col("id").alias("old_id"), best["id"].alias("canonical_id"))


def merge(entities: DataFrame, relationships: DataFrame, evidence: DataFrame, claims: DataFrame, mapped: DataFrame) -> dict[str, DataFrame]:
    """The tables after the merge. Names of the others become aliases; edges are pointed to the canonical entities and
    parallel ones become one (weights add up); loops that the merge makes go, others stay."""
    m = mapped.select(F.col("old_id").alias("_old"), F.col("canonical_id").alias("_new"))

    def moved(df: DataFrame, column: str) -> DataFrame:
        return df.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")

    e = entities.join(m, F.col("id") == F.col("_old"), "left").withColumn("_to", F.coalesce("_new", "id"))
    gone = e.filter("_to != id").groupBy(F.col("_to").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("aliases"))
    kept = e.filter("_to = id").drop("_old", "_new", "_to", "aliases").join(gone, "id", "left")
    kept = kept.withColumn("aliases", F.coalesce(F.filter("aliases", lambda a: a != F.col("name")), F.array().cast("array<string>")))
    r = moved(moved(relationships.withColumn("_loop", F.col("source_id") == F.col("target_id")), "source_id"), "target_id").filter("_loop or source_id != target_id")
    r = r.groupBy("graph_name", "source_id", "target_id", "type").agg(F.sum("weight").alias("weight"), F.min("description").alias("description"))
    return {"entities": kept, "relationships": r, "evidence": moved(evidence, "entity_id").distinct(), "claims": moved(claims, "entity_id")}


def combined(entities: DataFrame, mapped: DataFrame, property: str) -> DataFrame:
    """canonical_id, values: the distinct values of a property in each group, sorted."""
    x = mapped.join(entities.select(F.col("id").alias("old_id"), F.col(property).cast("string").alias("v")), "old_id").filter("v != ''")
    return x.groupBy("canonical_id").agg(F.array_sort(F.collect_set("v")).alias("values"))


def name_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b) with `embedding`, the cosine of their vectors (id, embedding) to 4 places; null without one."""
    v = vectors.select("id", F.col("embedding").cast("array<double>").alias("v"))
    x = pairs.join(v.select(F.col("id").alias("id_a"), F.col("v").alias("_a")), "id_a", "left").join(v.select(F.col("id").alias("id_b"), F.col("v").alias("_b")), "id_b", "left")
    norm = F.sqrt(dot(F.col("_a"), F.col("_a")) * dot(F.col("_b"), F.col("_b")))
    return x.withColumn("embedding", F.when(norm > 0, F.round(dot(F.col("_a"), F.col("_b")) / norm, 4))).drop("_a", "_b")


def review_prompt(a: Column, b: Column, guidance: str = "") -> Column:
    head = "Are these two entities the same? Answer as JSON with same_entity, merge_allowed, confidence (0 to 1) and reason." + (f"\n{guidance}" if guidance else "")
    return F.concat(F.lit(head + "\n\nA: "), a, F.lit("\nB: "), b)


def review(pairs: DataFrame, entities: DataFrame, chat, guidance: str = "", properties: list[str] | None = None) -> DataFrame:
    """Pairs (graph_name, type, id_a, id_b) with a model's same_entity, merge_allowed, confidence, reason and error. It is
    shown type, name and the given properties, the description by default; an answer that isn't JSON has nulls."""
    shown = [c for c in (properties or ["description"]) if c in entities.columns]
    profile = F.concat_ws("; ", "type", "name", *[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in shown])
    e = entities.select("graph_name", "id", profile.alias("p"))
    x = pairs.join(e.select("graph_name", F.col("id").alias("id_a"), F.col("p").alias("_a")), ["graph_name", "id_a"]).join(e.select("graph_name", F.col("id").alias("id_b"), F.col("p").alias("_b")), ["graph_name", "id_b"])
    asked = call(x, review_prompt(F.col("_a"), F.col("_b"), guidance), chat, "_c")
    body = F.regexp_extract(unfenced(F.col("_c")), r"(?s)(\{.*\})", 1)
    got = F.from_json(body, "same_entity boolean, merge_allowed boolean, confidence double, reason string")
    return asked.withColumn("_r", got).select(*pairs.columns, "_r.same_entity", "_r.merge_allowed", "_r.confidence", "_r.reason", "error")


def promote(reviewed: DataFrame, taken: DataFrame, merge_threshold: float = 95.0) -> DataFrame:
    """Pairs that a review found to be one, sure enough, of which neither is taken (id); of several that share an entity
    the first by ids. Greedy in order, a task for each graph and type; reviews are few."""
    good = reviewed.filter("same_entity and merge_allowed and id_a != id_b").filter(F.col("confidence") >= merge_threshold / 100)
    for side in ("id_a", "id_b"):
        good = good.join(taken.select(F.col("id").alias(side)).distinct(), side, "left_anti")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set = set()
        keep = []
        pdf = pdf.sort_values(["id_a", "id_b"])
        for a, b in zip(pdf["id_a"], pdf["id_b"], strict=True):
            keep.append(a not in used and b not in used)
            if keep[-1]:
                used |= {a, b}
        return pdf[keep][[*KEY, "id_a", "id_b"]]

    return good.select(*KEY, "id_a", "id_b").groupBy(*KEY).applyInPandas(walk, "graph_name string, type string, id_a string, id_b string")


@dataclass
class Resolution:
    mapping: DataFrame
    review: DataFrame
    stats: dict = field(default_factory=dict)


def resolve(entities: DataFrame, strategy: str = "normalized", merge_threshold: float = 95.0, review_threshold: float = 85.0, max_candidates: int = 20, aliases: DataFrame | None = None, rules: dict[str, list[str]] | None = None, unicode: bool = False, chat=None, guidance: str = "", properties: list[str] | None = None, auto_merge: bool = False) -> Resolution:
    """Groups by a strategy; hybrid also takes aliases, and a chat model's view of near names, which merges them if
    auto_merge allows it. Blocked groups and near names go to review.

    An entity that is in a group of equal names is in no other pair, so groups are disjoint."""
    if strategy not in STRATEGIES:
        raise ValueError(f"the strategy is one of {', '.join(STRATEGIES)}")
    found = groups(entities, strategy != "exact", unicode)
    review_ = None
    if strategy in ("fuzzy", "hybrid"):
        pairs = fuzzy(entities, merge_threshold, review_threshold, max_candidates, unicode)
        as_group = lambda p: p.select(*KEY, F.concat_ws("|", "id_a", "id_b").alias("key"), F.array_sort(F.array("id_a", "id_b")).alias("ids"))
        review_ = as_group(pairs.filter("decision = 'review'"))
        found = found.unionByName(as_group(pairs.filter("decision = 'merge'")))
        if strategy == "hybrid" and aliases is not None:
            taken = found.select(F.explode("ids").alias("id"))
            rest = entities.join(taken, "id", "left_anti")
            found = found.unionByName(as_group(alias_pairs(rest, aliases, unicode)))
        if strategy == "hybrid" and chat is not None and auto_merge:
            asked = review(pairs.filter("decision = 'review'").select(*KEY, "id_a", "id_b"), entities, chat, guidance, properties)
            promoted = cut(as_group(promote(asked, found.select(F.explode("ids").alias("id")), merge_threshold)))  # a model isn't asked twice
            review_ = review_.join(promoted.select(*KEY, "key"), [*KEY, "key"], "left_anti")
            found = found.unionByName(promoted)
    judged = conflicts(found, entities, rules or {})
    blocked = judged.filter("decision = 'blocked'").drop("decision")
    review_ = blocked.withColumn("reason", F.lit("conflict")) if review_ is None else review_.withColumn("reason", F.lit("fuzzy_candidate")).unionByName(blocked.withColumn("reason", F.lit("conflict")))
    good = judged.filter("decision = 'merge'").drop("decision")
    n = good.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("nodes")).first()
    return Resolution(mapping(good, entities), review_, {"strategy": strategy, "merged_groups": n["groups"], "merged_nodes": n["nodes"], "review_groups": review_.count()})
