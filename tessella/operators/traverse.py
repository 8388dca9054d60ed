"""Traversals of a property graph held as tables: degrees, neighbours, contexts, claims and citations.

Tables: entities (graph_name, id, type, name, description), relationships (graph_name, source_id, target_id, type, ...),
evidence (chunk_id, entity_id), chunks, documents, claims, memberships, communities, parents. All joins are equi-joins;
aggregates are made before the joins that would fan them out. Nulls: an entity without a name shows its description.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERNAL = ("embedding", "graph_name", "id", "text")
#: Bits of a Bloom filter for each id, and in all at most (each task has a copy; with more ids it lets more others pass).
ID_BITS, BLOOM_BITS = 8, 1 << 25


def label_of(type: Column, name: Column, description: Column) -> Column:
    return F.concat(type, F.lit(": "), F.coalesce(name, description, F.lit("")))


def might_be(column: str, ids: DataFrame) -> Column:
    """Is a column's value in the first column of ids, or one of a few others? A Bloom filter of theirs, made once in a
    plan as a subquery. The optimizer takes it to the scans, so what a join would drop isn't shuffled first; the join stays."""
    jvm = ids.sparkSession._jvm
    utils, expressions = jvm.org.apache.spark.sql.classic.ExpressionUtils, jvm.org.apache.spark.sql.catalyst.expressions
    of = lambda c: utils.expression(c._jc)
    n = max(1000, ids.count())
    made = expressions.aggregate.BloomFilterAggregate(of(F.xxhash64(ids.columns[0])), of(F.lit(n).cast("bigint")), of(F.lit(min(ID_BITS * n, BLOOM_BITS)).cast("bigint")))
    found = ids.coalesce(8).agg(Column(utils.column(made.toAggregateExpression())).alias("f"))
    return Column(utils.column(expressions.BloomFilterMightContain(of(found.scalar()), of(F.xxhash64(column)))))


def both_ways(relationships: DataFrame) -> DataFrame:
    """Each edge from both of its ends (src, dst); a loop once."""
    a = relationships.withColumnsRenamed({"source_id": "src", "target_id": "dst"})
    b = relationships.filter("source_id != target_id").withColumnsRenamed({"source_id": "dst", "target_id": "src"})
    return a.unionByName(b)


def degrees(relationships: DataFrame, claims: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """id, degree: edges at the entity, a loop once; claims about it count too. With ids (the first column of among), of
    these, and maybe a few others."""
    ends = both_ways(relationships).select(F.col("src").alias("id"))
    if claims is not None:
        ends = ends.unionByName(claims.select(F.col("entity_id").alias("id")))
    if among is not None:
        ends = ends.filter(might_be("id", among))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def neighbours(seeds: DataFrame, relationships: DataFrame, entities: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Undirected edges at the seeds (id): id, type, neighbor_id, neighbor (label: name). Claims are neighbours too."""
    names = entities.select(F.col("id").alias("neighbor_id"), label_of(F.col("type"), F.col("name"), F.col("description")).alias("neighbor"))
    hops = both_ways(relationships).select(F.col("src").alias("id"), F.col("type"), F.col("dst").alias("neighbor_id"))
    out = seeds.select("id").join(hops, "id").join(names, "neighbor_id").select("id", "type", "neighbor_id", "neighbor")
    if claims is not None:
        said = claims.select(F.col("entity_id").alias("id"), F.lit("SUBJECT_OF").alias("type"), F.col("id").alias("neighbor_id"), F.concat(F.lit("Claim: "), F.coalesce("description", F.lit(""))).alias("neighbor"))
        out = out.unionByName(seeds.select("id").join(said, "id").select("id", "type", "neighbor_id", "neighbor"))
    return out


def local_context(matches: DataFrame, entities: DataFrame, relationships: DataFrame, evidence: DataFrame, chunks: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Of matches (id, score): id, score, title, relationships, source_text, source_chunk_ids (sorted arrays)."""
    own = entities.join(matches, "id").select("id", "score", F.concat(F.coalesce("name", F.lit("")), F.lit(" ("), "type", F.lit(")")).alias("title"), label_of(F.col("type"), F.col("name"), F.col("description")).alias("_own"))
    near = neighbours(matches, relationships, entities, claims)
    # Sets of what follows the own name, which is put before them at the end: it would go through all shuffles with each line.
    near = near.groupBy("id").agg(F.collect_set(F.concat(F.lit(" -["), "type", F.lit("]-> "), "neighbor")).alias("_near"))
    each = near.join(own.select("id", "_own"), "id").select("id", F.transform("_near", lambda x: F.concat("_own", x)).alias("_near"))
    lines = each.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_near")))).alias("relationships"))
    seen = matches.select("id").join(evidence.select(F.col("entity_id").alias("id"), "chunk_id"), "id").join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id")
    texts = seen.groupBy("id").agg(F.array_sort(F.collect_set("text")).alias("source_text"), F.array_sort(F.collect_set("chunk_id")).alias("source_chunk_ids"))
    none = F.array().cast("array<string>")
    return own.drop("_own").join(lines, "id", "left").join(texts, "id", "left").select("id", "score", "title", *[F.coalesce(c, none).alias(c) for c in ("relationships", "source_text", "source_chunk_ids")])


def drift_context(matches: DataFrame, entities: DataFrame, relationships: DataFrame, evidence: DataFrame, chunks: DataFrame, memberships: DataFrame, communities: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """local_context() with `communities`, an array of (id, level, graph_name, summary)."""
    local = local_context(matches, entities, relationships, evidence, chunks, claims)
    found = matches.select("id").join(memberships.select(F.col("entity_id").alias("id"), "community_id", "level"), "id")
    c = communities.select(F.col("id").alias("community_id"), "level", "graph_name", "summary")
    found = found.join(c, ["community_id", "level"]).groupBy("id").agg(F.array_sort(F.collect_set(F.struct(F.col("community_id").alias("id"), "level", "graph_name", "summary"))).alias("communities"))
    return local.join(found, "id", "left")


def community_summaries(keys: DataFrame, communities: DataFrame, k: int = 3) -> DataFrame:
    """The summaries of keys (id, level), k of them, finest level first."""
    return communities.filter("summary is not null").join(keys.select("id", "level").distinct(), ["id", "level"]).select("id", "level", "summary").orderBy("level", "id").limit(k)


def within(relationships: DataFrame, memberships: DataFrame) -> DataFrame:
    """Edges whose two ends are in one community, with (community_id, level)."""
    m = memberships.select("entity_id", "community_id", "level")
    a = m.withColumnRenamed("entity_id", "source_id")
    b = m.withColumnRenamed("entity_id", "target_id")
    near = relationships.filter("source_id != target_id").filter(might_be("source_id", m) & might_be("target_id", m))
    return near.join(a, "source_id").join(b, ["target_id", "community_id", "level"])


def bridging(keys: DataFrame, memberships: DataFrame, entities: DataFrame, relationships: DataFrame, k: int = 50) -> DataFrame:
    """The members of communities (id, level) and what they are tied to inside: name, type, rels; k of them, by name and id."""
    m = memberships.join(keys.select(F.col("id").alias("community_id"), "level").distinct(), ["community_id", "level"])
    names = entities.select(F.col("id").alias("o"), F.coalesce("name", "description").alias("other"))
    x = within(relationships, m).select(F.least("source_id", "target_id").alias("id"), F.greatest("source_id", "target_id").alias("o"), F.col("type").alias("t"))
    ties = x.join(names, "o").groupBy("id").agg(F.array_sort(F.collect_set(F.concat("t", F.lit(" -> "), "other"))).alias("rels"))
    own = entities.join(m.select(F.col("entity_id").alias("id")).distinct(), "id")
    return own.join(ties, "id", "left").select("id", "name", "type", F.coalesce("rels", F.array().cast("array<string>")).alias("rels")).orderBy("name", "id").limit(k)


def ranked_edges(memberships: DataFrame, entities: DataFrame, relationships: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """The edges inside each community in rank order: community_id, level, rank, combined_degree, observation_count, and
    of both ends id, name, description, type, degree. Direction is kept."""
    members = memberships.select("entity_id")
    d = degrees(relationships, claims, members)
    e = entities.filter(might_be("id", members)).select("id", F.coalesce("name", "id").alias("name"), F.coalesce("description", F.lit("")).alias("description"), "type").join(d, "id", "left").fillna({"degree": 0})
    side = lambda p, key: e.select(*[F.col(c).alias(key if c == "id" else f"{p}_{c}") for c in e.columns])
    has = "observation_count" if "observation_count" in relationships.columns else "weight" if "weight" in relationships.columns else None
    x = within(relationships, memberships).join(side("source", "source_id"), "source_id").join(side("target", "target_id"), "target_id")
    x = x.withColumn("observation_count", (F.coalesce(has, F.lit(1)) if has else F.lit(1)).cast("bigint")).withColumn("combined_degree", F.col("source_degree") + F.col("target_degree"))
    by = Window.partitionBy("community_id", "level").orderBy(F.desc("combined_degree"), F.desc("observation_count"), "type", "source_id", "target_id")
    ends = [f"{p}_{c}" for p in ("source", "target") for c in ("id", "name", "description", "type", "degree")]
    return x.withColumn("rank", F.row_number().over(by)).select("community_id", "level", "rank", "type", "combined_degree", "observation_count", *ends)


def isolated(memberships: DataFrame, relationships: DataFrame) -> DataFrame:
    """Members without an edge inside their community."""
    x = within(relationships, memberships).select("community_id", "level", F.explode(F.array("source_id", "target_id")).alias("entity_id"))
    return memberships.select("community_id", "level", "entity_id").join(x, ["community_id", "level", "entity_id"], "left_anti")


def keyed(entities: DataFrame) -> DataFrame:
    """(key, id): the ids, canonical keys and readable ids an entity is known by; for a join instead of an OR."""
    have = [c for c in ("id", "canonical_key", "human_readable_id") if c in entities.columns]
    return entities.select(F.explode(F.array(*have)).alias("key"), "id").filter("key is not null").distinct()


def claims_for_entities(keys: DataFrame, entities: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims about entities that are known by keys (key)."""
    ids = keys.select("key").join(keyed(entities), "key").select(F.col("id").alias("entity_id")).distinct()
    return claims.join(ids, "entity_id").select(F.col("id").alias("claim_id"), "entity_id", "claim_type", "description", "status", "chunk_id")


def metadata(document: Column, chunk: Column) -> Column:
    """A document's metadata with the chunk's laid over it, without nulls and internal keys."""
    none = F.create_map().cast("map<string,string>")
    d, c = F.coalesce(document, none), F.coalesce(chunk, none)
    both = F.map_concat(F.map_filter(d, lambda k, v: ~F.array_contains(F.map_keys(c), k)), c)
    return F.map_filter(both, lambda k, v: v.isNotNull() & ~k.isin(*INTERNAL))


def citations(chunk_ids: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Of chunk ids (chunk_id): document_id, chunk_id, document_name, pages, metadata, excerpt; each once."""
    c = chunks.select(F.col("id").alias("chunk_id"), "document_id", "page_start", "page_end", F.col("metadata").alias("_c"), F.substring("text", 1, 200).alias("excerpt"))
    named = [x for x in ("title", "source", "filename") if x in documents.columns]
    d = documents.select(F.col("id").alias("document_id"), F.coalesce(*named, F.lit(None).cast("string")).alias("document_name"), F.col("metadata").alias("_d"))
    x = chunk_ids.select("chunk_id").distinct().join(c, "chunk_id").join(d, "document_id", "left")
    return x.select("document_id", "chunk_id", "document_name", "page_start", "page_end", metadata(F.col("_d"), F.col("_c")).alias("metadata"), "excerpt")


def chunks_of(references: DataFrame, entities: DataFrame, relationships: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """The chunks behind references (target_type, target_id): target_type, target_id, chunk_id.

    Relationships are known by id, keys and source:TYPE:target, and have source_chunk_ids."""
    ref = references.select("target_type", "target_id").distinct()
    e = ref.filter("target_type = 'entity'").join(keyed(entities).withColumnRenamed("key", "target_id"), "target_id")
    out = e.join(evidence.select(F.col("entity_id").alias("id"), "chunk_id"), "id").select("target_type", "target_id", "chunk_id")
    c = claims.select(F.col("id").alias("target_id"), "chunk_id").filter("chunk_id is not null")
    out = out.unionByName(ref.filter("target_type = 'claim'").join(c, "target_id").select("target_type", "target_id", "chunk_id"))
    if "source_chunk_ids" in relationships.columns:
        have = [x for x in ("id", "canonical_key", "human_readable_id") if x in relationships.columns]
        keys = F.array(*have, F.concat_ws(":", "source_id", "type", "target_id"))
        r = relationships.select(F.explode(keys).alias("target_id_"), "source_chunk_ids").filter("target_id_ is not null").withColumnRenamed("target_id_", "target_id")
        r = ref.filter("target_type = 'relationship'").join(r, "target_id").select("target_type", "target_id", F.explode("source_chunk_ids").alias("chunk_id"))
        out = out.unionByName(r)
    return out.distinct()


def sources(citations_: DataFrame) -> DataFrame:
    """Citations by document: document_id, document_name, chunk_ids (sorted), n."""
    return citations_.groupBy("document_id").agg(F.first("document_name", True).alias("document_name"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.count("*").alias("n"))


def community_stats(communities: DataFrame, memberships: DataFrame, parents: DataFrame) -> DataFrame:
    """community_id, level, entity_count, child_community_count; both are counted before they are joined."""
    e = memberships.groupBy(F.col("community_id").alias("id"), "level").agg(F.countDistinct("entity_id").alias("entity_count"))
    c = parents.groupBy(F.col("parent_id").alias("id"), F.col("parent_level").alias("level")).agg(F.countDistinct("child_id").alias("child_community_count"))
    x = communities.select("id", "level").join(e, ["id", "level"], "left").join(c, ["id", "level"], "left").fillna(0, ["entity_count", "child_community_count"])
    return x.select(F.col("id").alias("community_id"), "level", "entity_count", "child_community_count")


def community_children(communities: DataFrame, parents: DataFrame) -> DataFrame:
    """Children with a summary: parent_id, parent_level, child_id, level, summary."""
    c = communities.filter("summary is not null").select(F.col("id").alias("child_id"), F.col("level").alias("child_level"), "summary")
    return parents.filter("child_level = parent_level - 1").join(c, ["child_id", "child_level"]).select("parent_id", "parent_level", "child_id", F.col("child_level").alias("level"), "summary")


def community_counts(communities: DataFrame) -> DataFrame:
    """One row: communities, those with a summary, reports that failed."""
    failed = F.count_if(F.col("report_status") == "failed") if "report_status" in communities.columns else F.lit(0).cast("bigint")
    return communities.agg(F.count("*").alias("community_count"), F.count_if(F.coalesce("summary", F.lit("")) != "").alias("community_summary_count"), failed.alias("failed_report_count"))


def graph_counts(entities: DataFrame, relationships: DataFrame, chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: entities, relationships (raw, and from both ends), loops, chunks, evidence links."""
    r = relationships.agg(F.count("*").alias("relationship_count"), F.coalesce(F.sum(F.when(F.col("source_id") != F.col("target_id"), 2).otherwise(1)), F.lit(0)).alias("relationship_ends"), F.count_if(F.col("source_id") == F.col("target_id")).alias("self_loop_count"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(entities, "entity_count").crossJoin(r).crossJoin(count(chunks, "chunk_count")).crossJoin(count(evidence.distinct(), "evidence_count"))
