"""Registered queries of the graph engine and their SQL. Arrays are joined into strings, so that both sides compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import assembly, chunking, communities, context, extraction, mapreduce, resolve, search, traverse
from tessella.plans.trade import GRAPH, SQL, Trade
from tessella.sources import readers, store
from tessella.streaming import ingest

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Trade(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else sql.replace("@trade", "WITH RECURSIVE " + SQL.strip(), 1)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def joined(c: str | Column, by: str = "|") -> Column:
    return F.array_join(c, by)


def docs(t: Trade) -> DataFrame:
    return t.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("document_id"), "text")


# Text

_CHUNKS = """SELECT chunk_id, index, text, char_start, char_end FROM (
  SELECT 'd' || doc_id || ':chunk:' || i AS chunk_id, i::INTEGER AS index, substr(text, (i * {step} + 1)::BIGINT, {size}) AS text, (i * {step})::INTEGER AS char_start,
    least(i * {step} + {size}, length(text))::INTEGER AS char_end
  FROM (SELECT doc_id, text, unnest(range(ceil(greatest(0, length(text) - {size}) / {step}.0)::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0))
WHERE NOT regexp_full_match(text, '\\s*')"""


@query(_CHUNKS.format(size=1000, step=800))
def chunk_chars(t):
    return chunking.chunk_chars(docs(t)).select("chunk_id", "index", "text", "char_start", "char_end")


@query("""SELECT 'd' || doc_id || ':chunk:' || i AS chunk_id, substr(text, (i * 800 + 1)::BIGINT, 1000) AS text, (i * 200)::INTEGER AS token_start, (i * 200 + ceil(length(substr(text, (i * 800 + 1)::BIGINT, 1000)) / 4.0))::INTEGER AS token_end
FROM (SELECT doc_id, text, unnest(range(ceil(greatest(0, length(text) - 1000) / 800.0)::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0)
QUALIFY max(regexp_full_match(substr(text, (i * 800 + 1)::BIGINT, 1000), '\\s*')::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) = 0""")
def chunk_tokens_approx(t):
    return chunking.chunk_tokens(docs(t), 250, 50).select("chunk_id", "text", "token_start", "token_end")


@query("""SELECT 'c' || conv_id || ':pages:' || (s + 1) || '-' || least(s + 2, n) AS chunk_id, (s + 1)::INTEGER AS page_start, least(s + 2, n)::INTEGER AS page_end, array_to_string(texts[s + 1:s + 2], chr(10) || chr(10)) AS text, array_to_string(roles[s + 1:s + 2], '|') AS records
FROM (SELECT conv_id, count(*) AS n, list(coalesce(text, '') ORDER BY turn, coalesce(text, ''), role) AS texts, list(role ORDER BY turn, coalesce(text, ''), role) AS roles FROM conversations GROUP BY conv_id), LATERAL (SELECT unnest(range(greatest(0, n - 2) + 1)) AS s)""")
def page_windows_conversations(t):
    pages = t.table("conversations").withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))
    x = chunking.page_windows(pages, 2, 1, "conv_id", "turn", "text", "role")
    return x.select("chunk_id", "page_start", "page_end", "text", joined("record_ids").alias("records"))


@query("SELECT doc_id, ceil(length(text) / 4.0)::INTEGER AS tokens FROM documents")
def token_count(t):
    return t.table("documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("SELECT doc_id, substr(text, 1, 400) AS text FROM documents")
def truncate_text(t):
    return t.table("documents").select("doc_id", T.truncate(F.col("text"), 100).alias("text"))


@query("""SELECT doc_id, 'doc:' || coalesce(nullif(trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-'), ''), substr(sha256(text), 1, 16)) AS by_source, 'doc:' || substr(sha256(text), 1, 16) AS by_text FROM documents""")
def doc_id_slug(t):
    return t.table("documents").select("doc_id", T.document_id(F.col("text"), F.col("source")).alias("by_source"), T.document_id(F.col("text")).alias("by_text"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def text_hash(t):
    return t.table("documents").select("doc_id", T.text_hash(F.col("text")).alias("hash"))


@query(f"""@trade
SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT id, sha1(unhex('{T.NAMESPACE}') || encode('{T.ID_PREFIX}/entity/{GRAPH}/' || id)) AS h FROM entities)""")
def entity_uuid5(t):
    return t.entities.select("id", T.entity_uuid(F.lit(GRAPH), F.col("id")).alias("uuid"))


@query("""SELECT doc_id, 'claim:d' || doc_id || ':c0:' || substr(sha256('s' || doc_id || ':quality:' || quality), 1, 12) AS id FROM labels""")
def claim_id(t):
    k = lambda p: F.concat(F.lit(p), "doc_id")
    return t.table("labels").select("doc_id", T.claim_id(k("d"), F.lit("c0"), k("s"), F.lit("quality"), F.col("quality").cast("string")).alias("id"))


_NORM = r"""regexp_replace(regexp_replace(regexp_replace(lower({x}), '\b(corp|corporation|inc|incorporated|ltd|limited|llc|co|company|plc|llp|lp|holdings|group)\.?\b', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', '', 'g')"""


@query("@trade SELECT id, " + _NORM.format(x="name || ' Holdings, Inc.'") + " AS norm FROM entities")
def normalize_name(t):
    return t.entities.select("id", T.normalize_name(F.concat("name", F.lit(" Holdings, Inc."))).alias("norm"))


@query("""@trade SELECT id, type || ': ' || name || CASE WHEN description <> '' THEN ' - ' || description ELSE '' END AS text FROM entities""")
def entity_embedding_text(t):
    return t.entities.select("id", T.entity_text(F.col("type"), F.col("name"), F.col("description")).alias("text"))


_QUOTED = """(SELECT item_id, list_concat(list_transform(regexp_extract_all(text, '"([^"]+)"', 1), lambda p: '"' || p || '"'), list_transform(regexp_extract_all(regexp_replace(text, '"[^"]*"', ' ', 'g'), '[A-Za-z0-9_]+'), lambda w: '"' || w || '"')) AS l, text FROM {table})"""


@query("""SELECT item_id, CASE WHEN len(l) > 0 THEN array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] END), lambda x: x IS NOT NULL), ' OR ') ELSE '"' || replace(text, '"', '') || '"' END AS q FROM """ + _QUOTED.format(table="""(SELECT item_id, text FROM benchmark UNION ALL SELECT -1 - item_id, 'say "' || substr(text, 1, 9) || '" and "' || substr(text, 12) FROM benchmark)"""))
def lexical_query(t):
    """All items, and each once more with quotes in it, one of them open."""
    b = t.table("benchmark").select("item_id", "text")
    b = b.unionByName(b.select((-1 - F.col("item_id")).alias("item_id"), F.concat(F.lit('say "'), F.substring("text", 1, 9), F.lit('" and "'), F.expr("substr(text, 12)")).alias("text")))
    return b.select("item_id", T.lexical_query(F.col("text")).alias("q"))


# Assembly of the text graph: long words of chunks as entities, words that meet in a chunk as relationships. A word of one
# chunk only can't repeat a relationship

LOW = 2


def text_tokens(t: Trade) -> DataFrame:
    c = chunking.chunk_chars(docs(t))
    w = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(r"\p{L}{8,}"), F.lit(0)))
    return c.select("document_id", "chunk_id", F.col("index").alias("chunk_index"), F.posexplode(w).alias("pos", "term"))


_TOKENS = """WITH ch AS (""" + _CHUNKS.format(size=1000, step=800) + """), w AS (
  SELECT split_part(chunk_id, ':', 1) AS document_id, chunk_id, index AS chunk_index, regexp_extract_all(text, '\\p{L}{8,}') AS l FROM ch
), tokens AS (SELECT document_id, chunk_id, chunk_index, min(p) - 1 AS pos, l[p] AS term FROM w, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS p) GROUP BY ALL)
"""


@query(_TOKENS + f""", band AS (SELECT term FROM tokens GROUP BY term HAVING count(*) >= {LOW}), k AS (SELECT * FROM tokens JOIN band USING (term))
SELECT a.term AS source_id, b.term AS target_id, count(*)::DOUBLE AS weight, string_agg(a.chunk_id, '|' ORDER BY a.document_id, a.chunk_index) AS chunks
FROM k a JOIN k b ON a.chunk_id = b.chunk_id AND a.term < b.term GROUP BY ALL""")
def relationship_weight(t):
    x = assembly.related(text_tokens(t), LOW)
    return x.select("source_id", "target_id", "weight", joined("source_chunk_ids").alias("chunks"))


@query(_TOKENS + "SELECT term, arg_min(chunk_id, (document_id, chunk_index, pos)) AS first_chunk, count(*) AS n FROM tokens GROUP BY term")
def entity_first_seen(t):
    x = text_tokens(t).withColumn("node_id", F.col("term"))
    seen = x.groupBy("term").agg(F.count("*").alias("n"))
    first = assembly.entities(x.withColumns({"label": F.lit("Term"), "name": F.col("chunk_id")}), GRAPH).select(F.col("canonical_key").alias("term"), F.col("name").alias("first_chunk"))
    return first.join(seen, "term")


@query("""SELECT key, CASE WHEN length(d) > 2000 THEN substr(d, 1, 2000) || '...' ELSE d END AS description FROM (
  SELECT key, string_agg(text, '; ' ORDER BY document_id, chunk_id, pos) AS d FROM (
    SELECT key, text, place.document_id AS document_id, place.chunk_id AS chunk_id, place.pos AS pos FROM (SELECT 'user' || role AS key, trim(text) AS text, min({document_id: 'c' || conv_id, chunk_id: 'c' || conv_id || ':' || turn, pos: turn}) AS place FROM conversations WHERE trim(text) <> '' GROUP BY ALL) AS g
  ) GROUP BY key)""")
def description_consolidation(t):
    c = t.table("conversations").select(F.concat(F.lit("user"), "role").alias("key"), F.col("text").alias("description"), F.concat(F.lit("c"), "conv_id").alias("document_id"), F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn").alias("chunk_id"), F.col("turn").alias("pos"))
    return assembly.descriptions(c, ["key"])


@query(_TOKENS + "SELECT chunk_id, term AS node_id FROM tokens")
def evidence_links(t):
    return assembly.evidence(text_tokens(t).withColumn("node_id", F.col("term")))


def _json_chunks(t: Trade) -> DataFrame:
    """Orders as chunks that a model answered in JSON: a customer, its order, a thing without a label."""
    o = t.table("orders")
    js = F.concat(F.lit('```json\n{"nodes":[{"id":"c'), "o_custkey", F.lit('","label":"Customer","properties":{"name":"","title":"T'), "o_custkey", F.lit('","secret":"x"}},{"id":"o'), "o_orderkey", F.lit('","label":"'), F.when(F.col("o_orderstatus") == "F", "Order").otherwise("Thing"),
                  F.lit('"},{"id":"z"}],"relationships":[{"source_id":"c'), "o_custkey", F.lit('","target_id":"o'), "o_orderkey", F.lit('","type":"PLACED","properties":{"weight":"2.5"}},{"source_id":"o'), "o_orderkey", F.lit('","target_id":"c'), "o_custkey", F.lit('","type":"PLACED"},{"source_id":"","target_id":"x","type":"Y"}]}\n```'))
    x = o.select(F.concat(F.lit("k"), "o_orderkey").alias("chunk_id"), js.alias("content"))
    return x.withColumn("p", extraction.parse_items(F.col("content"))).select("chunk_id", "p.nodes", "p.relationships")


SCHEMA = extraction.build_schema([{"label": "Customer", "properties": ["segment"]}, {"label": "Order"}], ["PLACED"], [("Customer", "PLACED", "Order")])


@query("""SELECT 'k' || o_orderkey AS chunk_id, 'c' || o_custkey AS node_id, 'Customer' AS label, 'T' || o_custkey AS name FROM orders
UNION ALL SELECT 'k' || o_orderkey, 'o' || o_orderkey, 'Order', 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'F'""")
def schema_filter_nodes(t):
    return extraction.valid_nodes(_json_chunks(t), SCHEMA.labels(t.spark)).select("chunk_id", "node_id", "label", "name")


@query("SELECT 'k' || o_orderkey AS chunk_id, 'c' || o_custkey AS source_id, 'o' || o_orderkey AS target_id, 2.5::DOUBLE AS weight FROM orders WHERE o_orderstatus = 'F'")
def schema_filter_rels_pattern(t):
    x = _json_chunks(t)
    return extraction.valid_relationships(x, extraction.valid_nodes(x, SCHEMA.labels(t.spark)), SCHEMA).select("chunk_id", "source_id", "target_id", "weight")


@query("""SELECT 'claim:book:k' || o_orderkey || ':' || substr(sha256('c' || o_custkey || ':general:' || o_orderpriority), 1, 12) AS id, 'general' AS claim_type, o_orderpriority AS description, 'active' AS status FROM orders""")
def claim_records(t):
    js = F.concat(F.lit('[{"subject":"c'), "o_custkey", F.lit('","description":"'), "o_orderpriority", F.lit('"},{"subject":"nobody","description":"x"},{"subject":"c'), "o_custkey", F.lit('"}]'))
    o = t.table("orders").select(F.lit("book").alias("document_id"), F.concat(F.lit("k"), "o_orderkey").alias("chunk_id"), F.explode(extraction.parse_claims(js, F.array(F.concat(F.lit("c"), "o_custkey")))).alias("c"))
    return assembly.claims(o.select("document_id", "chunk_id", "c.*"), GRAPH).select("id", "claim_type", "description", "status")


# Store

@query("""SELECT 'k' || o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS last FROM orders GROUP BY o_custkey""")
def upsert_last_wins(t):
    o = t.table("orders").select(F.concat(F.lit("k"), "o_custkey").alias("id"), F.col("o_orderkey").alias("last"), F.col("o_orderstatus").alias("status"))
    mid = t.table("orders").agg(F.expr("percentile_approx(o_orderkey, 0.5)").alias("mid"))
    x = o.crossJoin(mid)
    return store.upsert(x.filter("last < mid").drop("mid"), x.filter("last >= mid").drop("mid"), ["id"], "last").select("id", "status", "last")


@query("""@trade SELECT 'entities' AS kind, type, count(*) AS n FROM entities GROUP BY ALL UNION ALL SELECT 'relationships', type, count(*) FROM relationships GROUP BY ALL""")
def label_type_counts(t):
    return store.type_counts(t.entities, "entities").unionByName(store.type_counts(t.relationships, "relationships"))


@query("""@trade SELECT (SELECT count(*) FROM entities) AS entity_count, (SELECT count(*) FROM relationships) AS relationship_count, (SELECT sum(CASE WHEN source_id <> target_id THEN 2 ELSE 1 END)::BIGINT FROM relationships) AS relationship_ends, (SELECT count_if(source_id = target_id)::BIGINT FROM relationships) AS self_loop_count,
  (SELECT count(*) FROM chunks) AS chunk_count, (SELECT count(*) FROM (SELECT DISTINCT * FROM evidence)) AS evidence_count""")
def graph_counts_undirected(t):
    return traverse.graph_counts(t.entities, t.relationships, t.chunks, t.evidence)


@query("""@trade SELECT 'chunks' AS kind, count(*) AS n FROM chunks JOIN documents_ d ON document_id = d.id UNION ALL SELECT 'evidence', count(*) FROM (SELECT DISTINCT chunk_id, entity_id FROM evidence JOIN chunks c ON chunk_id = c.id JOIN entities e ON entity_id = e.id)
UNION ALL SELECT 'relationships', count(*) FROM relationships JOIN entities a ON source_id = a.id JOIN entities b ON target_id = b.id""")
def write_stats(t):
    """What an upsert would lay in: rows whose ends exist."""
    tables = {"documents": t.documents, "chunks": t.chunks, "entities": t.entities}
    out = None
    for kind, rows in (("chunks", t.chunks), ("evidence", t.evidence), ("relationships", t.relationships)):
        n = store.only_known(kind, rows, tables.get).select(*store.KEYS[kind]).distinct().agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out


# Traversal

@query("""@trade SELECT id, sum(n)::BIGINT AS degree FROM (SELECT src AS id, count(*) AS n FROM both_ways GROUP BY 1 UNION ALL SELECT entity_id, count(*) FROM claims GROUP BY 1) GROUP BY id""")
def entity_degree(t):
    return traverse.degrees(t.relationships, t.claims)


@query("""@trade SELECT src AS id, b.type, dst AS neighbor_id, e.type || ': ' || e.name AS neighbor FROM both_ways b JOIN entities e ON dst = e.id UNION ALL SELECT entity_id, 'SUBJECT_OF', id, 'Claim: ' || description FROM claims""")
def one_hop_expand(t):
    return traverse.neighbours(t.entities, t.relationships, t.entities, t.claims)


_LOCAL = """, hops AS (SELECT s.id, list_sort(list(DISTINCT s.type || ': ' || s.name || ' -[' || x.type || ']-> ' || x.neighbor)) AS l FROM entities s JOIN (
  SELECT src AS id, b.type, e.type || ': ' || e.name AS neighbor FROM both_ways b JOIN entities e ON dst = e.id UNION ALL SELECT entity_id, 'SUBJECT_OF', 'Claim: ' || description FROM claims) x USING (id) GROUP BY s.id
), seen AS (SELECT entity_id AS id, list_sort(list(DISTINCT text)) AS texts, list_sort(list(DISTINCT chunk_id)) AS ids FROM evidence JOIN chunks c ON chunk_id = c.id GROUP BY entity_id)"""
_LOCAL_COLUMNS = "s.id, s.name || ' (' || s.type || ')' AS title, coalesce(array_to_string(l, '|'), '') AS relationships, coalesce(array_to_string(texts, '|'), '') AS sources, coalesce(array_to_string(ids, '|'), '') AS chunk_ids"


def matched(t: Trade) -> DataFrame:
    """All entities, as if a search had found them."""
    return t.entities.select("id", F.lit(1.0).alias("score"))


@query(f"@trade{_LOCAL} SELECT {_LOCAL_COLUMNS} FROM entities s LEFT JOIN hops USING (id) LEFT JOIN seen USING (id)")
def local_context(t):
    x = traverse.local_context(matched(t), t.entities, t.relationships, t.evidence, t.chunks, t.claims)
    return x.select("id", "title", joined("relationships").alias("relationships"), joined("source_text").alias("sources"), joined("source_chunk_ids").alias("chunk_ids"))


@query(f"""@trade{_LOCAL} SELECT {_LOCAL_COLUMNS}, (SELECT string_agg(c.id || ':' || c.level || ':' || c.summary, '|' ORDER BY c.id) FROM memberships m JOIN communities c ON m.community_id = c.id AND m.level = c.level WHERE m.entity_id = s.id) AS communities
FROM entities s LEFT JOIN hops USING (id) LEFT JOIN seen USING (id)""")
def drift_context(t):
    x = traverse.drift_context(matched(t), t.entities, t.relationships, t.evidence, t.chunks, t.memberships, t.communities, t.claims)
    c = F.transform("communities", lambda c: F.concat_ws(":", c["id"], c["level"].cast("string"), c["summary"]))
    return x.select("id", "title", joined("relationships").alias("relationships"), joined("source_text").alias("sources"), joined("source_chunk_ids").alias("chunk_ids"), joined(c).alias("communities"))


_WITHIN = """, inner_ AS (SELECT r.*, a.community_id, a.level FROM relationships r JOIN memberships a ON source_id = a.entity_id JOIN memberships b ON target_id = b.entity_id AND a.community_id = b.community_id AND a.level = b.level WHERE source_id <> target_id)"""


@query(f"""@trade{_WITHIN}, ties AS (SELECT least(source_id, target_id) AS id, list_sort(list(DISTINCT i.type || ' -> ' || e.name)) AS l FROM inner_ i JOIN entities e ON e.id = greatest(source_id, target_id) WHERE level = 0 GROUP BY 1)
SELECT e.id, e.name, coalesce(array_to_string(l, '|'), '') AS rels FROM entities e LEFT JOIN ties t USING (id) WHERE e.id IN (SELECT entity_id FROM memberships WHERE level = 0) ORDER BY name, id LIMIT 50""")
def bridging_entities(t):
    x = traverse.bridging(t.communities.filter("level = 0"), t.memberships, t.entities, t.relationships)
    return x.select("id", "name", joined("rels").alias("rels"))


_RANKED = _WITHIN + """, deg AS (SELECT id, sum(n)::BIGINT AS d FROM (SELECT src AS id, count(*) AS n FROM both_ways GROUP BY 1 UNION ALL SELECT entity_id, count(*) FROM claims GROUP BY 1) GROUP BY id
), ranked AS (SELECT i.community_id, i.level, i.type, i.source_id, i.target_id, x.d + y.d AS combined_degree, i.weight::BIGINT AS observation_count, row_number() OVER (PARTITION BY community_id, level ORDER BY x.d + y.d DESC, i.weight::BIGINT DESC, i.type, source_id, target_id) AS rank
  FROM inner_ i JOIN deg x ON source_id = x.id JOIN deg y ON target_id = y.id)"""


@query(f"@trade{_RANKED} SELECT community_id, level, rank::INTEGER AS rank, type, source_id, target_id, combined_degree, observation_count FROM ranked")
def ranked_community_context(t):
    return traverse.ranked_edges(t.memberships, t.entities, t.relationships, t.claims).select("community_id", "level", "rank", "type", "source_id", "target_id", "combined_degree", "observation_count")


@query(f"""@trade{_RANKED}, ends AS (SELECT community_id, level, rank, 0 AS slot, source_id AS id FROM ranked UNION ALL SELECT community_id, level, rank, 1, target_id FROM ranked
), lines AS (SELECT community_id, level, 0 AS part, r AS rank, slot, '' AS id, '- [' || e.type || '] ' || e.name || ': ' || e.description AS line FROM (SELECT community_id, level, id, min(rank) AS r, arg_min(slot, (rank, slot)) AS slot FROM ends GROUP BY ALL) f JOIN entities e USING (id)
  UNION ALL SELECT community_id, level, 0, rank, 2, '', '  ' || a.name || ' --[' || ranked.type || ']--> ' || b.name FROM ranked JOIN entities a ON source_id = a.id JOIN entities b ON target_id = b.id
  UNION ALL SELECT m.community_id, m.level, 1, 0, 0, m.entity_id, '- [' || e.type || '] ' || e.name || ': ' || e.description FROM memberships m JOIN entities e ON m.entity_id = e.id WHERE NOT EXISTS (SELECT 1 FROM ends x WHERE x.community_id = m.community_id AND x.level = m.level AND x.id = m.entity_id))
SELECT community_id, level, string_agg(line, chr(10) ORDER BY part, rank, slot, id) AS text FROM lines GROUP BY ALL""")
def render_context(t):
    return context.render(traverse.ranked_edges(t.memberships, t.entities, t.relationships, t.claims), traverse.isolated(t.memberships, t.relationships), t.entities)


@query()
def pack_context(t):
    return context.pack(traverse.ranked_edges(t.memberships, t.entities, t.relationships, t.claims), traverse.isolated(t.memberships, t.relationships), t.entities, 500)


@query(f"""@trade{_WITHIN} SELECT community_id, level, array_to_string(list_concat(list_sort(list(DISTINCT x) FILTER (p = 0)), coalesce(list_sort(list(DISTINCT x) FILTER (p = 1)), [])), '|') AS ids FROM (
  SELECT community_id, level, 0 AS p, entity_id AS x FROM memberships UNION ALL SELECT community_id, level, 1, source_id || ':' || type || ':' || target_id FROM inner_) GROUP BY ALL""")
def reference_allow_list(t):
    edges = traverse.ranked_edges(t.memberships, t.entities, t.relationships)
    return context.reference_ids(edges, traverse.isolated(t.memberships, t.relationships)).select("community_id", "level", joined("ids").alias("ids"))


@query("""@trade SELECT c.id AS community_id, c.level, (SELECT count(DISTINCT entity_id) FROM memberships m WHERE m.community_id = c.id AND m.level = c.level) AS entity_count, (SELECT count(DISTINCT child_id) FROM parents p WHERE p.parent_id = c.id AND p.parent_level = c.level) AS child_community_count FROM communities c""")
def community_stats(t):
    return traverse.community_stats(t.communities, t.memberships, t.parents)


@query("@trade SELECT parent_id, parent_level, child_id, level, summary FROM parents JOIN communities c ON child_id = c.id AND child_level = c.level")
def community_children(t):
    return traverse.community_children(t.communities, t.parents)


@query("@trade SELECT max(level) AS level FROM communities")
def level_coarsest(t):
    return t.communities.select(F.lit(communities.level_of(t.communities, "coarsest")).alias("level")).distinct()


@query("""@trade SELECT c.id AS claim_id, entity_id, claim_type, c.description, status, chunk_id FROM claims c JOIN entities e ON entity_id = e.id WHERE substr(e.name, length(e.name)) IN ('1', '3', '5')""")
def claims_for_entities(t):
    """Claims about the entities whose name ends in 1, 3 or 5, which are what is asked for."""
    return traverse.claims_for_entities(t.entities.filter(F.substring("name", -1, 1).isin("1", "3", "5")).select(F.col("id").alias("key")), t.entities, t.claims)


_CITED = "document_id, c.id AS chunk_id, d.title AS document_name, c.text AS excerpt, 'priority=' || d.priority || '|source=' || c.source || '|status=' || c.status AS metadata"


@query(f"@trade SELECT {_CITED} FROM chunks c JOIN documents_ d ON document_id = d.id WHERE c.id IN (SELECT chunk_id FROM evidence)")
def citations_entity(t):
    refs = t.entities.select(F.lit("entity").alias("target_type"), F.col("id").alias("target_id"))
    return _cited(t, traverse.chunks_of(refs, t.entities, t.relationships, t.evidence, t.claims))


def _cited(t: Trade, chunk_ids: DataFrame) -> DataFrame:
    x = traverse.citations(chunk_ids, t.chunks, t.documents)
    meta = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return x.select("document_id", "chunk_id", "document_name", "excerpt", joined(meta).alias("metadata"))


@query("""SELECT DISTINCT 'relationship' AS target_type, 'customer:' || o_custkey || ':ORDERED:part:' || l_partkey AS target_id, 'order:' || o_orderkey AS chunk_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def citations_relationship(t):
    x = t.table("lineitem").join(t.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = x.select(F.lit("b").alias("document_id"), F.concat(F.lit("order:"), "o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("chunk_index"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("customer:"), "o_custkey").alias("source_id"), F.lit("ORDERED").alias("type"), F.concat(F.lit("part:"), "l_partkey").alias("target_id"))
    rels = assembly.relationships(items)
    refs = rels.select(F.lit("relationship").alias("target_type"), F.concat_ws(":", "source_id", "type", "target_id").alias("target_id"))
    return traverse.chunks_of(refs, t.entities, rels, t.evidence, t.claims)


@query("@trade SELECT document_id, min(d.title) AS document_name, string_agg(c.id, '|' ORDER BY c.id) AS chunk_ids, count(*) AS n FROM chunks c JOIN documents_ d ON document_id = d.id GROUP BY document_id")
def sources_grouped(t):
    c = traverse.citations(t.chunks.select(F.col("id").alias("chunk_id")), t.chunks, t.documents)
    return traverse.sources(c).select("document_id", "document_name", joined("chunk_ids").alias("chunk_ids"), "n")


# Search

def _vectors(t: Trade) -> tuple[DataFrame, DataFrame]:
    e = search.unit_vectors(t.table("embeddings").select(F.col("vec_id").alias("id"), "label", "embedding"))
    q = e.groupBy("label").agg(F.min_by("embedding", "id").alias("embedding")).select(F.col("label").alias("query_id"), "embedding")
    return e, q


_VECTOR = """e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT label AS query_id, arg_min(v, id) AS qv FROM e GROUP BY label),
vector_ AS (SELECT query_id, id, list_cosine_similarity(v, qv) AS score FROM e, q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {k})"""


@query("WITH " + _VECTOR.format(k=10) + " SELECT query_id, id, round(score, 6) AS score FROM vector_")
def vector_topk(t):
    return search.vector_search(*_vectors(t), 10).select("query_id", "id", F.round("score", 6).alias("score"))


_BM25 = """names AS ({names}), qs AS ({queries}), w AS (SELECT id, list_filter(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS l FROM names),
post AS (SELECT term, id, any_value(length) AS length, count(*) AS tf FROM (SELECT id, len(l) AS length, unnest(l) AS term FROM w) GROUP BY term, id), st AS (SELECT count(*) AS n, avg(len(l)) AS mean FROM w WHERE len(l) > 0),
terms AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM qs), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
keyword_ AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM post JOIN terms USING (term) JOIN df USING (term), st GROUP BY query_id, id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, id) <= {k})"""
_KEYWORD = _BM25.format(names="SELECT doc_id AS id, text AS name FROM documents", queries="SELECT item_id AS query_id, text FROM benchmark", score="round(score, 9)", k=10)


@query("WITH " + _KEYWORD + " SELECT query_id, id, round(score, 6) AS score FROM keyword_")
def keyword_bm25_topk(t):
    x = search.bm25_texts(t.table("documents"), t.table("benchmark").select(F.col("item_id").alias("query_id"), "text"), 10, "doc_id", "text")
    return x.select("query_id", "id", F.round("score", 6).alias("score"))


_HYBRID = "WITH " + _VECTOR.format(k=20) + ", " + _BM25.format(names="SELECT vec_id AS id, 'label ' || label || ' x' || (vec_id % 7) AS name FROM embeddings", queries="SELECT DISTINCT label AS query_id, 'label ' || label || ' x3' AS text FROM embeddings", score="round(score, 9)", k=20) + """,
vs AS (SELECT query_id, id::VARCHAR AS id, score / max(score) OVER (PARTITION BY query_id) AS v FROM vector_), ks AS (SELECT query_id, id::VARCHAR AS id, score / max(score) OVER (PARTITION BY query_id) AS k FROM keyword_),
merged AS (SELECT query_id, id, coalesce(v, 0) AS v, coalesce(k, 0) AS k FROM vs FULL JOIN ks USING (query_id, id))
SELECT query_id, id, round({score}, 6) AS score FROM merged QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, id) <= 10"""


def _hybrid(t: Trade, ranker: str, alpha: float | None = None) -> DataFrame:
    e, q = _vectors(t)
    names = t.table("embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("label "), "label", F.lit(" x"), F.col("vec_id") % 7).alias("name"))
    asks = t.table("embeddings").select(F.col("label").alias("query_id"), F.concat(F.lit("label "), "label", F.lit(" x3")).alias("text")).distinct()
    tidy = lambda df: df.withColumn("score", F.round("score", 12))
    x = search.hybrid(tidy(search.vector_search(e, q, 20)), tidy(search.bm25_texts(names, asks, 20)), 10, ranker, alpha)
    return x.select("query_id", "id", F.round("score", 6).alias("score"))


@query(_HYBRID.replace("{score}", "greatest(v, k)"))
def hybrid_naive(t):
    return _hybrid(t, "naive")


@query(_HYBRID.replace("{score}", "0.25 * v + 0.75 * k"))
def hybrid_linear(t):
    return _hybrid(t, "linear", 0.25)


# Resolution

@query("""@trade SELECT type, name AS key, string_agg(id, '|' ORDER BY id) AS ids FROM entities GROUP BY type, name HAVING count(*) > 1""")
def resolve_exact(t):
    return resolve.groups(t.entities).select("type", "key", joined("ids").alias("ids"))


def variants(t: Trade) -> DataFrame:
    """All entities twice: as they are, and as companies with another spelling."""
    s = t.entities.select("graph_name", "id", "type", "name", "description")
    return s.unionByName(s.withColumns({"id": F.concat(F.lit("x"), "id"), "name": F.concat(F.upper("name"), F.lit(", Inc."))}))


_VARIANTS = """, variants AS (SELECT id, type, name FROM entities UNION ALL SELECT 'x' || id, type, upper(name) || ', Inc.' FROM entities)"""


@query(f"@trade{_VARIANTS} SELECT type, norm AS key, string_agg(id, '|' ORDER BY id) AS ids FROM (SELECT *, {_NORM.format(x='name')} AS norm FROM variants) GROUP BY type, norm HAVING count(*) > 1")
def resolve_normalized(t):
    return resolve.groups(variants(t), True).select("type", "key", joined("ids").alias("ids"))


_PAIRS = f""", n AS (SELECT id, type, {_NORM.format(x='name')} AS norm FROM entities), s AS (SELECT * FROM n QUALIFY count(*) OVER (PARTITION BY type, norm) = 1),
pairs AS (SELECT a.id AS id_a, b.id AS id_b, a.norm AS x, b.norm AS y FROM s a JOIN s b ON a.type = b.type AND a.id <> b.id AND substr(a.norm, 1, 1) = substr(b.norm, 1, 1) AND abs(length(a.norm) - length(b.norm)) <= greatest(3, floor(least(length(a.norm), length(b.norm)) * 0.4))
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.id) <= 20)"""


@query(f"@trade{_PAIRS} SELECT id_a, id_b FROM pairs")
def fuzzy_candidates(t):
    return resolve.candidates(t.entities).select("id_a", "id_b")


@query(f"""@trade{_PAIRS}, m AS (SELECT id_a, id_b, x, y, (1::HUGEINT << length(y)::INTEGER) - 1 AS every,
  list_transform(string_split(x, ''), lambda c: list_sum(list_transform(range(length(y)), lambda j: CASE WHEN y[j + 1] = c THEN 1::HUGEINT << j::INTEGER ELSE 0::HUGEINT END))::HUGEINT) AS hits FROM pairs
), v AS (SELECT *, list_reduce(list_prepend(every, hits), lambda v, h: ((v + (v & h)) | (v - (v & h))) & every) AS left_ FROM m)
SELECT id_a, id_b, round(200.0 * (length(y) - bit_count(left_)) / (length(x) + length(y)), 4)::DOUBLE AS score FROM v""")
def fuzzy_score_indel(t):
    return resolve.scores(resolve.candidates(t.entities)).select("id_a", "id_b", F.round("score", 4).alias("score"))


@query()
def fuzzy_greedy(t):
    return resolve.fuzzy(t.entities)


def _aliases(t: Trade) -> DataFrame:
    s = t.table("supplier").select(F.lit(None).cast("string").alias("domain"), F.col("s_name").alias("canonical"), F.concat(F.lit("Alias of "), "s_name").alias("alias"))
    return s


@query("@trade SELECT id AS id_a, 'y' || id AS id_b FROM entities WHERE type = 'Supplier'")
def resolve_alias(t):
    s = t.entities.filter("type = 'Supplier'")
    both = t.entities.unionByName(s.withColumns({"id": F.concat(F.lit("y"), "id"), "name": F.concat(F.lit("Alias of "), "name")}))
    return resolve.alias_pairs(both, _aliases(t)).select("id_a", "id_b")


@query("""@trade SELECT type, name AS key, CASE WHEN count(DISTINCT lower(description)) > 1 THEN 'blocked' ELSE 'merge' END AS decision FROM entities GROUP BY type, name HAVING count(*) > 1""")
def resolve_conflicts(t):
    return resolve.conflicts(resolve.groups(t.entities), t.entities, {"Part": ["description"]}).select("type", "key", "decision")


def _merged(t: Trade) -> dict[str, DataFrame]:
    m = resolve.mapping(resolve.groups(t.entities), t.entities)
    return resolve.merge(t.entities, t.relationships, t.evidence, t.claims, m)


_MAPPED = ", mapped AS (SELECT id AS old_id, min(id) OVER (PARTITION BY type, name) AS canonical_id FROM entities)"


@query(f"""@trade{_MAPPED} SELECT coalesce(a.canonical_id, source_id) AS source_id, coalesce(b.canonical_id, target_id) AS target_id, type, sum(weight) AS weight FROM relationships LEFT JOIN mapped a ON source_id = a.old_id LEFT JOIN mapped b ON target_id = b.old_id
WHERE source_id = target_id OR coalesce(a.canonical_id, source_id) <> coalesce(b.canonical_id, target_id) GROUP BY ALL""")
def merge_rewire(t):
    return _merged(t)["relationships"].select("source_id", "target_id", "type", "weight")


@query("@trade SELECT min(id) AS canonical_id, array_to_string(list_sort(list(DISTINCT description)), '|') AS \"values\" FROM entities WHERE description <> '' GROUP BY type, name HAVING count(*) > 1")
def combine_properties(t):
    m = resolve.mapping(resolve.groups(t.entities), t.entities)
    return resolve.combined(t.entities, m, "description").select("canonical_id", joined("values").alias("values"))


# Communities and global search

def _regional(t: Trade) -> DataFrame:
    return communities.project(t.relationships, ["LOCATED_IN", "PART_OF"])


@query("@trade SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, sum(weight) AS w FROM relationships WHERE type IN ('LOCATED_IN', 'PART_OF') AND source_id <> target_id GROUP BY ALL")
def community_projection(t):
    return _regional(t).select("a", "b", "w")


@query()
def communities_detect(t):
    return communities.detect(communities.project(t.relationships))


@query("""@trade SELECT DISTINCT a.community_id AS child_id, a.level AS child_level, b.community_id AS parent_id, b.level AS parent_level FROM memberships a JOIN memberships b USING (entity_id) WHERE b.level = a.level + 1""")
def community_parents(t):
    return communities.tables(t.memberships)[1].select("child_id", "child_level", "parent_id", "parent_level")


@query("""@trade SELECT entity_id, CASE WHEN level = 0 THEN community_id || '|' ELSE '' END || 'r' || n_regionkey || '|' || 'n' || nation AS path FROM memberships JOIN placed USING (entity_id) JOIN nation ON nation = n_nationkey""")
def community_paths(t):
    """Paths of ids, of which equal neighbours fall together."""
    own = t.memberships.filter("level = 0").select("entity_id", F.col("community_id").alias("n"))
    x = t.memberships.join(own, "entity_id").join(t.memberships.filter("level = 1").select("entity_id", F.col("community_id").alias("r")), "entity_id")
    path = communities.normal_path(F.when(F.col("level") == 0, F.array("community_id", "community_id", "r")).otherwise(F.array("community_id", "r")), F.col("n"))
    return x.select("entity_id", joined(path).alias("path"))


@query("""@trade SELECT p.parent_id AS community_id, p.parent_level AS level, string_agg('Community ' || child_id || ' (level ' || c.level || '):' || chr(10) || summary, chr(10) || chr(10) ORDER BY child_id) AS text FROM parents p JOIN communities c ON child_id = c.id AND child_level = c.level GROUP BY ALL""")
def child_summaries(t):
    return context.child_context(traverse.community_children(t.communities, t.parents))


@query("@trade SELECT count(*) AS community_count, count_if(summary <> '')::BIGINT AS community_summary_count, count_if(report_status = 'failed')::BIGINT AS failed_report_count FROM communities")
def validation_communities(t):
    return traverse.community_counts(t.communities)


@query("@trade SELECT id, level, summary FROM communities ORDER BY level, id LIMIT 10")
def summaries_by_key(t):
    """The ten first of all keys, finest level first."""
    return traverse.community_summaries(t.communities.select("id", "level"), t.communities, 10)


@query("@trade SELECT id, level, report_text AS summary FROM communities WHERE report_status <> 'failed'")
def read_reports(t):
    return mapreduce.read_reports(t.communities)


@query("@trade SELECT id, 'entity' AS target_type, CASE WHEN level = 0 THEN 'nation:' ELSE 'region:' END || substr(id, 2) AS target_id FROM communities")
def report_refs_text(t):
    return t.communities.select("id", F.explode(context.text_references(F.col("report_text"))).alias("r")).select("id", "r.*")


def _reports(t: Trade) -> DataFrame:
    js = F.concat(F.lit('{"title":"'), "n_name", F.lit('","summary":"S","rating":"7.5","findings":[{"description":"low","rank":1,"references":[{"target_type":"entity","target_id":"nation:'), "n_nationkey", F.lit('"},{"target_type":"thing","target_id":"q"}]},{"description":"high","rank":2,"references":[{"target_type":"claim","target_id":"c'), "n_nationkey", F.lit('"}]},{"description":"none","rank":9,"references":[]}]}'))
    return t.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), js.alias("report_json"), F.array(F.concat(F.lit("nation:"), "n_nationkey"), F.concat(F.lit("c"), "n_nationkey")).alias("ids"))


@query("SELECT 'n' || n_nationkey AS id, 'entity' AS target_type, 'nation:' || n_nationkey AS target_id FROM nation UNION ALL SELECT 'n' || n_nationkey, 'claim', 'c' || n_nationkey FROM nation")
def report_refs_json(t):
    return _reports(t).select("id", F.explode(context.json_references(F.col("report_json"))).alias("r")).select("id", "r.*")


@query("""SELECT 'n' || n_nationkey AS id, '# ' || n_name || chr(10) || chr(10) || 'S' || chr(10) || chr(10) || '- high [refs: claim:c' || n_nationkey || ']' || chr(10) || '- low [refs: entity:nation:' || n_nationkey || ']' AS text FROM nation""")
def report_text_render(t):
    r = context.parse_report(F.col("report_json"), F.col("ids"), F.col("id"), F.lit(0))
    return _reports(t).select("id", context.report_text(r).alias("text"))


def _answers(t: Trade) -> DataFrame:
    """A map answer for each order: fenced, in prose, or broken."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"answer":"a'), k, F.lit('","helpfulness":"'), k % 120, F.lit('","report_ids":["r'), k % 3, F.lit('","r9"],"references":[{"target_type":"entity","target_id":"e'), k % 5, F.lit('"}]}'))
    said = F.when(k % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit("Well: "), body, F.lit(" so."))).otherwise(F.when(k % 2 == 0, body).otherwise(F.lit("no")))
    x = t.table("orders").select(k.cast("string").alias("batch_id"), said.alias("content"), F.array(F.lit("r0"), F.lit("r1")).alias("batch_report_ids"))
    return x.withColumn("p", mapreduce.parse_map_udf("content")).select("batch_id", "p.answer", "p.helpfulness", "p.report_ids", "p.references", "batch_report_ids", F.col("p.bad").alias("error"))


_ANSWERS = """a AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS batch_id, NOT (o_orderkey % 3 = 2 AND o_orderkey % 2 = 1) AS ok, o_orderkey % 120 AS h FROM orders)"""


@query("WITH " + _ANSWERS + " SELECT batch_id, CASE WHEN ok THEN 'a' || k ELSE '' END AS answer, CASE WHEN ok AND h <= 100 THEN h ELSE 0 END::INTEGER AS helpfulness, CASE WHEN ok THEN 'entity:e' || (k % 5) ELSE '' END AS refs FROM a")
def map_parse(t):
    refs = F.transform("references", lambda r: F.concat_ws(":", r["target_type"], r["target_id"]))
    return _answers(t).select("batch_id", "answer", "helpfulness", joined(refs).alias("refs"))


_SCORED = "WITH " + _ANSWERS + ", s AS (SELECT *, row_number() OVER (ORDER BY h DESC, batch_id) AS place FROM a WHERE ok AND h BETWEEN 1 AND 100)"


@query(_SCORED + """, u AS (SELECT place, 'r' || (k % 3) AS report_id, 0 AS pos FROM s WHERE k % 3 < 2 UNION ALL SELECT place, unnest(['r0', 'r1']), unnest([0, 1]) FROM s WHERE k % 3 = 2)
SELECT report_id, place::INTEGER AS place FROM u QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY place, pos) = 1""")
def used_report_ids(t):
    return mapreduce.used_reports(mapreduce.scored(_answers(t))).select("report_id", "place")


@query(_SCORED + """, x AS (SELECT place, '[Score ' || h || '] a' || k || chr(10) || 'References: entity:e' || (k % 5) AS text FROM s), y AS (SELECT *, sum(ceil(length(text) / 4.0)) OVER (ORDER BY place) AS total FROM x)
SELECT place::INTEGER AS place, text FROM y WHERE total <= 2000 OR place = 1""")
def partial_sort_reduce_prefix(t):
    return mapreduce.reduce_texts(mapreduce.scored(_answers(t)), 2000).select("place", "text")


def _items(t: Trade) -> DataFrame:
    """Lines of orders, the quantity as their tokens; equal line numbers go by that."""
    return t.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").cast("bigint").alias("tokens"))


@query("""WITH RECURSIVE i AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::BIGINT) AS r, l_linenumber AS ord, l_quantity::BIGINT AS tokens FROM lineitem
), f AS (SELECT id, r, ord, CASE WHEN tokens <= 60 THEN tokens ELSE 0 END AS used, tokens <= 60 AS included FROM i WHERE r = 1
  UNION ALL SELECT i.id, i.r, i.ord, f.used + CASE WHEN f.used + tokens <= 60 THEN tokens ELSE 0 END, f.used + tokens <= 60 FROM f JOIN i ON i.id = f.id AND i.r = f.r + 1)
SELECT id, ord, included FROM f""")
def pack_items(t):
    return context.pack_items(_items(t), 60, "id", "ord", "tokens").select("id", "ord", "included")


@query("""@trade, r AS (SELECT level, id, row_number() OVER (PARTITION BY level ORDER BY id) AS r, 'Report ' || id || ':' || chr(10) || report_text AS text FROM communities WHERE report_status <> 'failed'
), t AS (SELECT *, ceil(length(text) / 4.0)::BIGINT AS n FROM r), f AS (SELECT level, id, r, text, 0::BIGINT AS batch_id, n AS used, n FROM t WHERE r = 1
  UNION ALL SELECT t.level, t.id, t.r, t.text, f.batch_id + CASE WHEN f.used + t.n > 60 THEN 1 ELSE 0 END, CASE WHEN f.used + t.n > 60 THEN 0 ELSE f.used END + t.n, t.n FROM f JOIN t ON t.level = f.level AND t.r = f.r + 1)
SELECT level, batch_id::INTEGER AS batch_id, string_agg(id, '|' ORDER BY id) AS report_ids, string_agg(text, chr(10) || chr(10) ORDER BY id) AS text, sum(n)::BIGINT AS tokens FROM f GROUP BY ALL""")
def batch_pack(t):
    return mapreduce.batches(mapreduce.read_reports(t.communities), 60).select("level", "batch_id", joined("report_ids").alias("report_ids"), "text", "tokens")


@query("""WITH RECURSIVE i AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::BIGINT) AS r, l_linenumber AS ord, l_quantity::BIGINT AS n, repeat('x', (4 * l_quantity)::INTEGER) AS text FROM lineitem
), f AS (SELECT id, r, ord, least(n, 60) AS used, least(n, 60) AS given, n, text FROM i WHERE r = 1
  UNION ALL SELECT i.id, i.r, i.ord, f.used + least(i.n, 60 - f.used), least(i.n, 60 - f.used), i.n, i.text FROM f JOIN i ON i.id = f.id AND i.r = f.r + 1)
SELECT id, ord, given AS tokens, length(substr(text, 1, (4 * given)::BIGINT)) AS characters, given > 0 AS included, given > 0 AND given < n AS truncated FROM f""")
def pack_items_truncated(t):
    x = _items(t).withColumn("text", F.expr("repeat('x', cast(4 * tokens as int))"))
    return context.pack_items(x, 60, "id", "ord", "tokens", "text").select("id", "ord", "tokens", F.length("text").cast("bigint").alias("characters"), "included", "truncated")


_REFS = """x AS (SELECT 0 AS src, place, 'entity' AS target_type, 'e' || (k % 5) AS target_id FROM s UNION ALL SELECT 1, k, 'claim', 'c' || (k % 7) FROM a UNION ALL SELECT 1, k, 'entity', 'e' || (k % 9) FROM a)"""


@query(_SCORED + ", " + _REFS + """, f AS (SELECT target_type, target_id, src, place FROM x QUALIFY row_number() OVER (PARTITION BY target_type, target_id ORDER BY src, place) = 1)
SELECT row_number() OVER (ORDER BY src, place, target_type, target_id)::INTEGER AS pos, target_type, target_id FROM f""")
def reference_union(t):
    """References of answers, then of reports, each once in order."""
    explicit = mapreduce.scored(_answers(t)).select("place", F.explode("references").alias("r")).select("place", "r.*")
    k = F.col("o_orderkey")
    each = F.explode(F.array(F.struct(F.lit("claim").alias("target_type"), F.concat(F.lit("c"), k % 7).alias("target_id")), F.struct(F.lit("entity").alias("target_type"), F.concat(F.lit("e"), k % 9).alias("target_id")), F.struct(F.lit("thing").alias("target_type"), F.lit("x").alias("target_id")))).alias("r")
    reported = t.table("orders").select(k.cast("int").alias("place"), each).select("place", "r.*")
    return mapreduce.all_references(explicit.select("place", "target_type", "target_id"), reported.select("place", "target_type", "target_id")).select("pos", "target_type", "target_id")


@query("""SELECT 'n' || n_nationkey AS id, '{"findings":[{"description":"low","id":"finding:0","rank":1.0,"references":[{"target_id":"nation:' || n_nationkey || '","target_type":"entity"}]},{"description":"high","id":"finding:1","rank":2.0,"references":[{"target_id":"c' || n_nationkey || '","target_type":"claim"}]}],"id":"report:n' || n_nationkey || ':0","rating":7.5,"rating_explanation":"","summary":"S","title":"' || n_name || '"}' AS json FROM nation""")
def report_json_text(t):
    return _reports(t).select("id", context.report_json(context.parse_report(F.col("report_json"), F.col("ids"), F.col("id"), F.lit(0))).alias("json"))


@query("""SELECT 'doc:conv-' || conv_id || ':pages:' || (s + 1) || '-' || least(s + 2, n) AS chunk_id, s::INTEGER AS index, array_to_string(texts[s + 1:s + 2], chr(10) || chr(10)) AS text,
  'collections=["talk"]|lang=x|page_end=' || least(s + 2, n) || '|page_start=' || (s + 1) || '|record_ids=["' || array_to_string(roles[s + 1:s + 2], '","') || '"]|source=conv ' || conv_id || '|source_ids=["' || array_to_string(roles[s + 1:s + 2], '","') || '"]' AS metadata
FROM (SELECT conv_id, count(*) AS n, list(coalesce(text, '') ORDER BY turn, coalesce(text, ''), role) AS texts, list(role ORDER BY turn, coalesce(text, ''), role) AS roles FROM conversations GROUP BY conv_id), LATERAL (SELECT unnest(range(greatest(0, n - 2) + 1)) AS s)""")
def envelope_windows(t):
    """Conversations as envelopes of pages, their windows with all metadata."""
    page = F.struct("turn", F.coalesce("text", F.lit("")).alias("text"), F.col("role"))
    pages = t.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(page)).alias("p"))
    envelopes = pages.select(F.transform("p", lambda p: F.struct(p["text"].alias("text"), F.create_map(F.lit("record_id"), p["role"], F.lit("collection"), F.lit("talk")).alias("metadata"))).alias("pages"), F.create_map(F.lit("source"), F.concat(F.lit("conv "), "conv_id"), F.lit("lang"), F.lit("x")).alias("metadata"))
    x = chunking.with_metadata(chunking.envelope_windows(readers.envelopes(envelopes).select("document_id", "metadata", "pages")))
    meta = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return x.select("chunk_id", "index", "text", joined(meta).alias("metadata"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(t):
    x = ingest.windowed_counts(t.table("events"))
    return x.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local context of the customers that match a query best."""
    t = Trade(spark, sf_dir)
    names = t.entities.filter("type = 'Customer'")
    q = spark.createDataFrame([("q", "customer building")], "query_id string, text string")
    texts = names.withColumn("name", F.concat_ws(" ", F.regexp_replace("name", "#", " "), "description"))
    found = search.bm25_texts(texts, q, 10).select("id", "score")
    x = traverse.local_context(found, t.entities, t.relationships, t.evidence, t.chunks, t.claims)
    return x.select("id", F.round("score", 6).alias("score"), "title", joined("relationships", "\n").alias("relationships"), joined("source_chunk_ids").alias("chunk_ids"))
