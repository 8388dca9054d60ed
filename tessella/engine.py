"""The engine: builds a graph in a store out of documents, and answers queries over it."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import entity_text, token_count
from tessella.models import embed
from tessella.operators import assembly, chunking, communities, context, extraction, mapreduce, resolve, search, traverse
from tessella.sources import readers
from tessella.sources.lineage import cut, ship
from tessella.sources.store import GraphStore


@dataclass
class Answer:
    query: str
    mode: str
    answer: str | None
    context: str
    citations: list[dict] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)

    @property
    def sources(self) -> dict[str, list[dict]]:
        """Citations by document, in order."""
        out: dict[str, list[dict]] = {}
        for c in self.citations:
            out.setdefault(c["document_id"], []).append(c)
        return out


class Engine:
    """A graph of one name in a store. chat and embedder are as in tessella.models, prompts the templates of what is asked."""

    def __init__(self, spark: SparkSession, path: str, graph: str = "entity-graph", schema: extraction.Schema | None = None, chat=None, embedder=None, prompts: extraction.Prompts = extraction.Prompts()):
        self.spark, self.store, self.graph, self.schema, self.chat, self.embedder, self.prompts = spark, GraphStore(spark, path), graph, schema, chat, embedder, prompts
        ship(spark)

    # Building

    def build(
        self, documents: DataFrame, size: int = 1000, overlap: int = 200, unit: str = "chars", window: int = 2, window_overlap: int = 1,
        counter: chunking.TokenCounter | None = None, gleanings: int = 0, with_claims: bool = False,
    ) -> dict[str, int]:
        """Chunks envelopes, extracts, filters by the schema, assembles and writes; the rows written by table.

        Texts are cut by characters or tokens (a counter's, approximate ones without it), pages into windows. Chunks have
        their document's metadata, with what they are of it laid over.
        """
        if unit not in ("chars", "tokens"):
            raise ValueError("the unit is chars or tokens")
        if window <= 0 or not 0 <= window_overlap < window:
            raise ValueError("the window has to be positive, its overlap 0 at least and smaller")
        docs = cut(readers.envelopes(documents))
        texts = docs.filter("pages is null").select("document_id", "text", "metadata")
        if unit == "chars":
            chunks = chunking.chunk_chars(texts, size, overlap)
        elif counter is None:
            chunks = chunking.chunk_tokens(texts, size, overlap)
        else:
            meta = texts.select("document_id", "metadata").groupBy("document_id").agg(F.first("metadata", True).alias("metadata"))
            chunks = chunking.chunk_exact(texts, counter, size, overlap).join(meta, "document_id", "left")
        windows = chunking.envelope_windows(docs.select("document_id", "metadata", "pages"), window, window - window_overlap)
        place = ["document_id", "chunk_id", "index", "text", "metadata"]
        both = chunking.with_metadata(chunks).select(*place).unionByName(chunking.with_metadata(windows).select(*place, "page_start", "page_end"), allowMissingColumns=True)
        return self.ingest(docs.drop("pages"), both, gleanings, with_claims)

    def results(self, documents: DataFrame) -> DataFrame:
        """A row for each envelope, as they are: document_id, and how many chunks, entities and relationships of it the store has."""
        chunks = self._own("chunks").select("document_id", F.col("id").alias("chunk_id"))
        count = lambda of, what, name: of.groupBy("document_id").agg(F.countDistinct(*what).alias(name))
        found = chunks.join(self._own("evidence"), "chunk_id")
        linked = self._own("relationships").select("source_id", "type", "target_id", F.explode("source_chunk_ids").alias("chunk_id")).join(chunks, "chunk_id")
        out = readers.envelopes(documents).select("document_id")
        for x in (count(chunks, ["chunk_id"], "chunk_count"), count(found, ["entity_id"], "entity_count"), count(linked, ["source_id", "type", "target_id"], "relationship_count")):
            out = out.join(x, "document_id", "left")
        return out.fillna(0)

    def build_pages(self, pages: DataFrame, size: int = 2, step: int = 1, **options) -> dict[str, int]:
        """The same of pages as rows (document_id, page, text, and record_id, source, collection where they are), by windows."""
        docs = pages.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
        docs = docs.withColumns({"text_hash": F.sha2("text", 256), "metadata": F.create_map().cast("map<string,string>")})
        named = [c if c in pages.columns else None for c in ("record_id", "collection", "source")]
        windows = chunking.with_metadata(chunking.page_windows(pages, size, step, "document_id", "page", "text", *named))
        return self.ingest(docs, windows, **options)

    def ingest(self, docs: DataFrame, chunks: DataFrame, gleanings: int = 0, with_claims: bool = False) -> dict[str, int]:
        g = F.lit(self.graph)
        asked = cut(extraction.extract(chunks, self.schema, self.chat, gleanings, self.prompts))  # models aren't asked twice
        extraction.check_errors(asked)
        nodes = extraction.valid_nodes(asked, self.schema.labels(self.spark))
        place = asked.select("chunk_id", "document_id", F.col("index").alias("chunk_index"))
        rels = extraction.valid_relationships(asked, nodes, self.schema).join(place, "chunk_id")
        nodes = nodes.join(place, "chunk_id")
        ents = assembly.entities(nodes, self.graph)
        ids = ents.select("canonical_key", "id")
        described = assembly.descriptions(nodes.withColumn("canonical_key", F.coalesce(F.try_element_at("properties", F.lit("canonical_key")), F.col("node_id"))), ["canonical_key"])
        ents = ents.join(described, "canonical_key", "left").fillna("", ["description"])
        known = nodes.select("chunk_id", "node_id", F.coalesce(F.try_element_at("properties", F.lit("canonical_key")), F.col("node_id")).alias("canonical_key")).join(ids, "canonical_key").select("chunk_id", "node_id", "id").distinct()
        for end in ("source", "target"):
            rels = rels.join(known.withColumnsRenamed({"node_id": f"{end}_id", "id": f"_{end}"}), ["chunk_id", f"{end}_id"]).drop(f"{end}_id").withColumnRenamed(f"_{end}", f"{end}_id")
        edges = assembly.relationships(rels, self.graph).join(assembly.descriptions(rels, ["source_id", "type", "target_id"]), ["source_id", "type", "target_id"], "left").fillna("", ["description"])
        tables = {
            "documents": docs.select(g.alias("graph_name"), F.col("document_id").alias("id"), "text_hash", F.try_element_at("metadata", F.lit("title")).alias("title"), "metadata"),
            "chunks": asked.select(g.alias("graph_name"), F.col("chunk_id").alias("id"), "document_id", "text", "index", *[(F.col(c) if c in asked.columns else F.lit(None).cast("int")).alias(c) for c in ("page_start", "page_end")], F.col("metadata") if "metadata" in asked.columns else F.create_map().cast("map<string,string>").alias("metadata")),
            "entities": ents, "relationships": edges,
            "evidence": known.select(g.alias("graph_name"), "chunk_id", F.col("id").alias("entity_id")).distinct(),
        }
        if with_claims:
            subjects = nodes.groupBy("chunk_id").agg(F.array_sort(F.collect_set("node_id")).alias("subjects"))
            said = cut(extraction.call(asked.drop("error").join(subjects, "chunk_id"), extraction.claims_prompt(F.col("subjects"), F.col("text"), self.prompts), self.chat))
            items = said.select("document_id", "chunk_id", F.explode(extraction.parse_claims(F.col("content"), F.col("subjects"))).alias("c")).select("document_id", "chunk_id", "c.*")
            tables["claims"] = assembly.claims(items, self.graph)
        return self.store.write(tables)

    def _own(self, name: str) -> DataFrame:
        t = self.store.table(name)
        if t is None:
            raise ValueError(f"the store has no {name}")
        return t.filter(F.col("graph_name") == self.graph)

    def _claims(self) -> DataFrame | None:
        return self._own("claims") if self.store.exists("claims") else None

    def resolve(self, strategy: str = "normalized", dry_run: bool = False, **options) -> dict:
        """Merges what resolve.resolve() finds; a dry run only counts. Others' graphs stay as they are."""
        e = self._own("entities")
        r = resolve.resolve(e, strategy, **options)
        if not dry_run and r.stats["merged_groups"]:
            none = self.spark.createDataFrame([], "graph_name string, id string, entity_id string, chunk_id string, claim_type string, description string, status string")
            old = {"entities": e, "relationships": self._own("relationships"), "evidence": self._own("evidence"), "claims": self._claims() if self._claims() is not None else none}
            for name, new in resolve.merge(old["entities"], old["relationships"], old["evidence"], old["claims"], cut(r.mapping)).items():
                if self.store.exists(name):
                    others = self.store.table(name).filter(F.col("graph_name") != self.graph)
                    self.store.replace(name, others.unionByName(new, allowMissingColumns=True))
        return r.stats

    def embed_entities(self) -> int:
        """Embeds the entities that have no vector; the number that failed."""
        todo = self.store.unembedded(self.graph)
        made = cut(embed(todo.select("graph_name", "id", entity_text(F.col("type"), F.col("name"), F.col("description")).alias("t")), F.col("t"), self.embedder))
        self.store.upsert_vectors(made.filter("embedding is not null"))
        return made.filter("embed_error is not null").count()

    def detect(self, types: list[str] | None = None, max_levels: int = 3, gamma: float = 1.0, seed: int = 42) -> DataFrame:
        """Builds the community tables anew."""
        m = cut(communities.detect(communities.project(self._own("relationships"), types), max_levels, gamma, seed=seed))
        c, p = communities.tables(m)
        self.store.delete_communities(self.graph)
        none = F.lit(None).cast("string")
        self.store.write({"communities": c.withColumns({"summary": none, "report_text": none, "report_json": none, "report_status": none, "input_fingerprint": none}), "memberships": m, "parents": p})
        return traverse.community_stats(self._own("communities"), self._own("memberships"), self._own("parents"))

    def summarise(self, skip_existing: bool = True, max_tokens: int | None = None, repair: bool = True, children: bool = False, concurrency: int | None = None) -> int:
        """Reports of all communities, finest level first; the number that failed.

        One that has a report of the same context (by fingerprint) is left alone. With max_tokens a context holds the
        highest ranked edges, then members and claims that fit. An answer that can't be used is sent back once to be
        mended. With children, a community above the finest level is told by its children's reports, where it has some.
        concurrency bounds the tasks that ask at once.
        """
        e, r, m, claims = self._own("entities"), self._own("relationships"), self._own("memberships"), self._claims()
        edges, lone = traverse.ranked_edges(m, e, r, claims), traverse.isolated(m, r)
        own = None if claims is None else m.join(claims.select("entity_id", "id", "claim_type", "description"), "entity_id").select("community_id", "level", "id", "claim_type", "description").distinct()
        told = context.render(edges, lone, e, own) if max_tokens is None else context.pack(edges, lone, e, max_tokens).select("community_id", "level", "text")
        texts = cut(told.join(context.reference_ids(edges, lone, own), ["community_id", "level"]))
        bad = 0
        ask = lambda x, prompt: extraction.call(x if concurrency is None else x.repartition(concurrency), prompt, self.chat)
        parsed = lambda x: x.withColumn("rep", context.parse_report(F.col("content"), F.col("ids"), F.col("community_id"), F.col("level")))
        for level in range((self._own("communities").agg(F.max("level")).first()[0] or 0) + 1):
            old = self._own("communities").filter(F.col("level") == level)
            todo = texts.filter(F.col("level") == level)
            if children and level:
                below = context.child_context(traverse.community_children(self._own("communities"), self._own("parents")), max_tokens).withColumnRenamed("text", "below")
                todo = todo.join(below, ["community_id", "level"], "left").withColumn("text", F.coalesce(F.when(F.col("below") != "", F.col("below")), F.col("text"))).drop("below")
            todo = todo.withColumn("input_fingerprint", F.sha2("text", 256))
            if skip_existing:
                done = old.filter("coalesce(summary, '') != ''").select(F.col("id").alias("community_id"), "input_fingerprint")
                todo = todo.join(done, ["community_id", "input_fingerprint"], "left_anti")
            rep = cut(parsed(ask(todo, context.report_prompt(F.col("community_id"), F.col("level"), F.col("text"), F.col("ids"), self.prompts))))
            if repair:
                wrong = rep.filter("rep is null and content is not null")
                prompt = context.repair_prompt(context.report_problems(F.col("_old"), F.col("ids")), F.col("_old"), F.col("ids"), self.prompts)
                again = parsed(ask(wrong.drop("error", "rep").withColumnRenamed("content", "_old"), prompt)).drop("_old")
                rep = cut(rep.filter("rep is not null or content is null").unionByName(again))
            made = cut(rep.select(F.lit(self.graph).alias("graph_name"), "level", F.col("community_id").alias("id"), context.report_text(F.col("rep")).alias("report_text"), context.report_json(F.col("rep")).alias("report_json"), F.when(F.col("rep").isNull(), "failed").otherwise("success").alias("report_status"), "input_fingerprint"))
            made = made.withColumn("report_text", F.when(F.col("report_status") == "success", F.col("report_text"))).withColumn("summary", F.col("report_text"))
            bad += made.filter("report_status = 'failed'").count()
            self.store.write({"communities": made})
        return bad

    # Search

    def matches(self, query: str, k: int = 10, ratio: int = 2, ranker: str = "naive", alpha: float | None = None, types: list[str] | None = None) -> DataFrame:
        """id, score of the entities that answer a query best, by vectors where there are any and by names; of some types only, if given."""
        q = self.spark.createDataFrame([(query,)], "text string").select(F.lit("q").alias("query_id"), "text")
        e = self._own("entities")
        if types is not None:
            e = e.filter(F.col("type").isin(*types))
        if types is None and self.store.exists("index_names"):
            keyword = search.bm25(self._own("index_names").drop("graph_name"), q, k * ratio)
        else:
            keyword = search.bm25_texts(e, q, k * ratio)
        if self.embedder is None or "embedding" not in e.columns:
            return keyword.filter(F.col("rank") <= k).select("id", "score")
        v = search.unit_vectors(self.spark.createDataFrame([("q", self.embedder.embed(query))], "query_id string, embedding array<double>"))
        if self.store.exists("index_vectors"):
            index = self._own("index_vectors")
            index = index if types is None else index.filter(F.col("type").isin(*types))
        else:
            index = search.unit_vectors(e.filter("embedding is not null").select("id", "embedding"))
        return search.hybrid(search.vector_search(index, v, k * ratio), keyword, k, ranker, alpha).select("id", "score")

    def _local(self, query: str, k: int, drift: bool, metadata_keys: list[str] | None = None, **options) -> tuple[list, str, list[dict], dict]:
        began = time.time()
        found = cut(self.matches(query, k, **options))
        args = (found, self._own("entities"), self._own("relationships"), self._own("evidence"), self._own("chunks"))
        x = traverse.drift_context(*args, self._own("memberships"), self._own("communities"), self._claims()) if drift else traverse.local_context(*args, self._claims())
        rows = x.orderBy(F.desc("score"), "id").collect()
        ids = list(dict.fromkeys(c for r in rows for c in r["source_chunk_ids"]))
        cited = traverse.citations(self.spark.createDataFrame([(c,) for c in ids], "chunk_id string"), self._own("chunks"), self._own("documents")).collect() if ids else []
        at = {c: i for i, c in enumerate(ids)}
        cited = [r.asDict(recursive=True) for r in sorted(cited, key=lambda r: at[r["chunk_id"]])]
        stats = {"retrieved": len(rows), "source_chunks": len(ids), "citations": len(cited), "documents": len({c["document_id"] for c in cited}), "relationships": sum(len(r["relationships"]) for r in rows), "retrieval_ms": int((time.time() - began) * 1000)}
        return rows, formatted(rows, cited, metadata_keys, drift), cited, stats

    def _answer(self, query: str, text: str, synthesize: bool) -> str | None:
        return self.chat.invoke(f"Answer from the context.\n\nQuestion: {query}\n\nContext:\n{text}") if synthesize else None

    def local(self, query: str, k: int = 10, synthesize: bool = True, **options) -> Answer:
        """options: those of matches(), and metadata_keys, the keys of citations' metadata that the context shows (all without it)."""
        _, text, cited, stats = self._local(query, k, False, **options)
        return Answer(query, "local", self._answer(query, text, synthesize), text, cited, stats | {"context_tokens": -(-len(text) // 4)})

    def drift(self, query: str, k: int = 10, level: int | str | None = 0, community_k: int = 3, synthesize: bool = True, **options) -> Answer:
        at = communities.level_of(self._own("communities"), level)
        rows, text, cited, stats = self._local(query, k, True, **options)
        keys = sorted({(c["level"], c["id"]) for r in rows for c in r["communities"] or [] if at is None or c["level"] == at})
        parts, used, bridges = [], [], []
        if keys:
            df = self.spark.createDataFrame([(i, n) for n, i in keys], "id string, level int")
            used = traverse.community_summaries(df, self._own("communities"), community_k).collect()
            bridges = traverse.bridging(df, self._own("memberships"), self._own("entities"), self._own("relationships")).collect()
        for head, body in (("Communities", "\n\n".join(r["summary"] for r in used)), ("Findings", text), ("Between them", "\n".join(f"  {r['name']}: {', '.join(r['rels'])}" for r in bridges))):
            if body:
                parts.append(f"{head}:\n{body}")
        full = "\n\n".join(parts)
        stats |= {"communities": len(keys), "community_summaries": len(used), "bridging_entities": len(bridges), "level": at, "context_tokens": -(-len(full) // 4)}
        return Answer(query, "drift", self._answer(query, full, synthesize), full, cited, stats)

    def globally(self, query: str, level: int | str | None = "coarsest", budget: int = 8000, seed: int | None = 42, concurrency: int = 5, most: int | None = None) -> Answer:
        began = time.time()
        at = communities.level_of(self._own("communities"), level)
        if at is None:
            return Answer(query, "global", mapreduce.REFUSAL, "")
        reports = mapreduce.read_reports(self._own("communities"), at)
        order = mapreduce.shuffled([r["id"] for r in reports.select("id").collect()], seed)
        if not order:
            return Answer(query, "global", "There are no reports at this level.", "")
        reports = reports.join(self.spark.createDataFrame(list(order.items()), "id string, place int"), "id")
        spare = budget - -(-len(mapreduce.MAP_PROMPT.format(query=query, text="")) // 4)
        made = cut(mapreduce.batches(reports, spare if spare > 0 else 1000, "place"))
        partials = cut(mapreduce.map_phase(made, query, self.chat, concurrency))
        good = cut(mapreduce.scored(partials, most))
        if not good.count():
            return Answer(query, "global", "No report helps with this question.", "", [], {"batches": partials.count()})
        used = mapreduce.used_reports(good)
        explicit = good.select("place", F.explode("references").alias("r")).select("place", "r.*")
        both = self._own("communities").filter(F.col("level") == at).join(used, F.col("id") == F.col("report_id"))
        refs = F.coalesce(context.json_references(F.col("report_json")), context.text_references(F.col("report_text"))) if "report_json" in both.columns else context.text_references(F.col("report_text"))
        reported = both.select("place", F.explode(refs).alias("r")).select("place", "r.*")
        every = mapreduce.all_references(explicit.select("place", "target_type", "target_id"), reported.select("place", "target_type", "target_id"))
        claims = self._claims()
        none = self.spark.createDataFrame([], "id string, chunk_id string")
        chunks = traverse.chunks_of(every, self._own("entities"), self._own("relationships"), self._own("evidence"), none if claims is None else claims)
        cited = [r.asDict(recursive=True) for r in traverse.citations(chunks, self._own("chunks"), self._own("documents")).orderBy("document_id", "chunk_id").collect()]
        parts = mapreduce.reduce_texts(good, budget - -(-len(mapreduce.REDUCE_PROMPT.format(query=query, text="")) // 4)).orderBy("place").collect()
        text = "\n\n".join(r["text"] for r in parts)
        n = partials.agg(F.count("*").alias("batches"), F.count("error").alias("errors"), F.count_if(F.expr("error is null and helpfulness = 0")).alias("unhelpful")).first()
        stats = {
            "level": at, "reports": len(order), **n.asDict(), "scored": good.count(), "reduced": len(parts), "used_reports": used.count(), "references": every.count(), "citations": len(cited),
            "seed": seed, "budget": budget, "map_tokens": made.agg(F.sum("tokens")).first()[0], "context_tokens": -(-len(text) // 4), "elapsed_ms": int((time.time() - began) * 1000),
        }
        return Answer(query, "global", self.chat.invoke(mapreduce.REDUCE_PROMPT.format(query=query, text=text)), text, cited, stats)

    def search(self, query: str, mode: str = "local", **options) -> Answer:
        modes = {"local": self.local, "global": self.globally, "drift": self.drift}
        if mode not in modes:
            raise ValueError(f"the mode is one of {', '.join(modes)}")
        return modes[mode](query, **options)

    def counts(self) -> dict:
        """Entities, relationships, loops, chunks, evidence, and where communities were built those, the ones with a summary and reports that failed."""
        row = traverse.graph_counts(self._own("entities"), self._own("relationships"), self._own("chunks"), self._own("evidence"))
        if self.store.exists("communities"):
            row = row.crossJoin(traverse.community_counts(self._own("communities")))
        return row.first().asDict()

    def tokens(self) -> int:
        return self._own("chunks").agg(F.sum(token_count(F.col("text")))).first()[0] or 0


def formatted(rows: list, cited: list[dict] = (), keys: list[str] | None = None, drift: bool = False) -> str:
    """Context rows as text: title, connections, evidence (3 texts, 2 for drift) and the metadata of what is cited, as JSON."""
    said = {c["chunk_id"]: {k: v for k, v in (c["metadata"] or {}).items() if keys is None or k in keys} for c in cited}
    out = []
    for r in rows:
        part = [f"Finding: {r['title']}"]
        about = [f"{c}: {json.dumps(said[c], sort_keys=True)}" for c in r["source_chunk_ids"] if said.get(c)]
        head, indent = ("  ", "    ") if drift else ("", "  ")
        for name, values in (("Connections", r["relationships"]), ("Evidence", r["source_text"][: 2 if drift else 3]), ("Citation metadata", about)):
            if values:
                part.append(f"{head}{name}:\n{indent}" + f"\n{indent}".join(values))
        out.append("\n".join(part))
    return ("\n\n" if drift else "\n\n---\n\n").join(out)
