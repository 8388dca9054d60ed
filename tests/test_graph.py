import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.engine import Engine
from tessella.models import FakeChat, HashEmbedder, Scripted
from tessella.operators import assembly, communities, context, extraction, mapreduce, resolve, search, traverse
from tessella.plans.trade import Trade
from tessella.sources import readers, store


def ents(spark, names, kind="Organization"):
    return spark.createDataFrame([("g", f"e{i}", kind, n, "") for i, n in enumerate(names)], "graph_name string, id string, type string, name string, description string")


def test_cooccurrence_of_frequent_terms(spark):
    rows = [("d", f"d:{i}", i, term) for i in range(60) for term in ("everywhere", "frequent", *(["sometimes"] if i < 3 else []), f"once{i}")]
    tokens = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index int, term string")
    got = assembly.relationships(assembly.cooccurrence(tokens, 2)).collect()
    assert {(r.source_id, r.target_id): r.weight for r in got} == {("everywhere", "frequent"): 60, ("everywhere", "sometimes"): 3, ("frequent", "sometimes"): 3}
    assert assembly.cooccurrence(tokens, 2, 40).count() == 0


def test_related_is_what_occurrences_add_up_to(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(f"d{d}", f"d{d}:{i}", i, f"t{'é' * (x % 3)}{x}") for d in range(12) for i in (2, 10, 9) for x in np.unique(r.zipf(1.4, 25) % 60).tolist()]
    tokens = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index int, term string")
    for name, value in (("RUN_PAIRS", 300), ("BUCKET_PAIRS", 500), ("OUT_PAIRS", 7)):
        monkeypatch.setattr(assembly, name, value)
    for least, most in ((2, None), (3, 20)):
        want = assembly.relationships(assembly.cooccurrence(tokens, least, most))
        got = assembly.related(tokens, least, most)
        assert got.dtypes == [(c, t) for c, t in want.select(got.columns).dtypes]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect())) and got.count() > 100
    assert assembly.related(tokens, 999).count() == 0
    assert assembly.related(tokens.limit(1).union(tokens.limit(1)), 2).count() == 0
    # No row for each occurrence goes through a shuffle: what does are a bucket's blobs.
    assert "pairs" in assembly.related(tokens, 2)._jdf.queryExecution().toString() and "posexplode" not in assembly.related(tokens, 2)._jdf.queryExecution().toString()


def test_exact_and_normalized_groups(spark):
    assert [r.ids for r in resolve.groups(ents(spark, ["OpenAI", "OpenAI", "openai"])).collect()] == [["e0", "e1"]]
    assert [r.ids for r in resolve.groups(ents(spark, ["Microsoft Corp.", "Microsoft Corporation", None]), True).collect()] == [["e0", "e1"]]


def test_fuzzy_thresholds(spark):
    got = resolve.fuzzy(ents(spark, ["John Smith", "Jon Smith"], "Person")).collect()
    assert [(r.id_a, r.id_b, r.decision) for r in got] == [("e0", "e1", "review")]
    assert resolve.fuzzy(ents(spark, ["ABC", "ABD"])).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [max(row[j + 1], 0, row[j] + 1 if x == y else 0) for j, y in enumerate(b)]
        for j in range(1, len(row)):
            row[j] = max(row[j], row[j - 1])
    return row[-1]


def test_greedy_pairs_against_a_plain_walk(spark):
    r = np.random.default_rng(2)
    base = ["".join(r.choice(list("abcde"), int(r.integers(9, 26)))) for _ in range(60)]
    names = base + [b[:k] + "x" + b[k + 1 :] for b in base for k in (4, 7)][:70]
    names = [names[i] for i in r.permutation(len(names))]
    for k in (20, 3):
        norm = {f"e{i}": n for i, n in enumerate(names)}
        norm = {i: n for i, n in norm.items() if list(norm.values()).count(n) == 1}
        gone, seen, want = set(), set(), set()
        for a in sorted(norm):
            if a in gone:
                continue
            tried = 0
            for b in sorted(norm):
                x, y = norm[a], norm[b]
                if b == a or b in gone or x[0] != y[0] or abs(len(x) - len(y)) > max(3, int(min(len(x), len(y)) * 0.4)):
                    continue
                tried += 1
                if tried > k:
                    break
                score = 200 * lcs(x, y) / (len(x) + len(y))
                if frozenset((a, b)) in seen or score < 85:
                    continue
                seen.add(frozenset((a, b)))
                want.add((a, b, round(score, 2), "merge" if score >= 95 else "review"))
                if score >= 95:
                    gone |= {a, b}
                break
        got = {(x.id_a, x.id_b, x.score, x.decision) for x in resolve.fuzzy(ents(spark, names), k=k).collect()}
        assert got == want and len(got) > 20 and {d for *_, d in got} == {"merge", "review"}


def test_packed_contexts_against_a_plain_fold(spark):
    t = Trade(spark, "/root/testdata/sf0.001")
    edges, lone = traverse.ranked_edges(t.memberships, t.entities, t.relationships, t.claims), traverse.isolated(t.memberships, t.relationships)
    rows, alone = edges.collect(), lone.collect()
    about = {e.id: e for e in t.entities.collect()}
    for budget in (0, 60, 500):
        got = {(r.community_id, r.level): r for r in context.pack(edges, lone, t.entities, budget).collect()}
        assert set(got) == {(x.community_id, x.level) for x in rows} | {(x.community_id, x.level) for x in alone}
        for key, r in got.items():
            lines, seen, used, out = [], set(), 0, 0
            tell = lambda i: f"- [{about[i].type}] {about[i].name}: {about[i].description}"
            own = sorted((x for x in rows if (x.community_id, x.level) == key), key=lambda x: x["rank"])
            rest = sorted(x.entity_id for x in alone if (x.community_id, x.level) == key)
            ends = {i for x in own for i in (x.source_id, x.target_id)} | set(rest)
            for x in own:
                text = "\n".join([*(tell(i) for i in dict.fromkeys((x.source_id, x.target_id)) if i not in seen), f"  {x.source_name} --[{x.type}]--> {x.target_name}"])
                n = -(-len(text) // 4)
                if budget and used + n <= budget:
                    used, seen = used + n, seen | {x.source_id, x.target_id}
                    lines.append(text)
                else:
                    out += 1
            for i in rest:
                n = -(-len(tell(i)) // 4)
                if budget and used + n <= budget:
                    used, seen = used + n, seen | {i}
                    lines.append(tell(i))
            assert (r.text, r.used_tokens, r.excluded_edges, r.excluded_entities) == ("\n".join(lines), used, out, len(ends - seen))


def test_candidates_are_the_first_by_id(spark):
    r = np.random.default_rng(1)
    names = ["".join(r.choice(list("ab"), int(r.integers(1, 14)))) + str(i) for i in range(120)]
    e = ents(spark, names)
    norm = {f"e{i}": n for i, n in enumerate(names)}
    want = set()
    for a, x in norm.items():
        ok = [b for b, y in sorted(norm.items()) if b != a and x[0] == y[0] and abs(len(x) - len(y)) <= max(3, int(0.4 * min(len(x), len(y))))]
        want |= {(a, b) for b in ok[:5]}
    assert {(r.id_a, r.id_b) for r in resolve.candidates(e, 5).collect()} == want


def test_aliases(spark):
    a = spark.createDataFrame([("Organization", "IBM", "International Business Machines"), (None, "ACME", "Nobody")], "domain string, canonical string, alias string")
    got = resolve.alias_pairs(ents(spark, ["IBM", "International Business Machines", "ACME"]), a).collect()
    assert [(r.id_a, r.id_b) for r in got] == [("e0", "e1")]


def test_conflicts_block(spark):
    e = ents(spark, ["A", "A", "B", "B"]).withColumn("country", F.when(F.col("id") == "e0", " US").when(F.col("id") == "e1", "us").when(F.col("id") == "e2", "us").otherwise("fr"))
    got = {r.key: r.decision for r in resolve.conflicts(resolve.groups(e), e, {"*": ["country"]}).collect()}
    assert got == {"A": "merge", "B": "blocked"}


def test_a_model_reviews_near_names(spark):
    e = ents(spark, ["John Smith", "Jon Smith", "Jane Doe"], "Person")
    said = Scripted(lambda p: 'Sure: {"same_entity": true, "merge_allowed": true, "confidence": 0.97}' if "John Smith" in p else "no")
    assert resolve.resolve(e, "hybrid").stats["merged_groups"] == 0
    r = resolve.resolve(e, "hybrid", chat=said, auto_merge=True)
    assert r.stats["merged_groups"] == 1 and r.stats["review_groups"] == 0
    assert {x.old_id: x.canonical_id for x in r.mapping.collect()} == {"e0": "e0", "e1": "e0"}
    pairs = spark.createDataFrame([("e0", "e1"), ("e0", "e2")], "id_a string, id_b string")
    v = spark.createDataFrame([("e0", [1.0, 0.0]), ("e1", [1.0, 1.0])], "id string, embedding array<double>")
    assert {x.id_b: x.embedding for x in resolve.name_similarity(pairs, v).collect()} == {"e1": 0.7071, "e2": None}


def test_merge_moves_edges(spark):
    e = ents(spark, ["Acme Inc", "Acme", "Bob"])
    rel = spark.createDataFrame([("g", "e2", "e0", "W", 1.0, "x"), ("g", "e2", "e1", "W", 2.0, "y"), ("g", "e0", "e1", "S", 1.0, ""), ("g", "e2", "e2", "L", 1.0, "")], "graph_name string, source_id string, target_id string, type string, weight double, description string")
    ev = spark.createDataFrame([("g", "c", "e0"), ("g", "c", "e1")], "graph_name string, chunk_id string, entity_id string")
    cl = spark.createDataFrame([("g", "k", "e1", "c")], "graph_name string, id string, entity_id string, chunk_id string")
    r = resolve.resolve(e)
    assert r.stats["merged_groups"] == 1 and r.stats["merged_nodes"] == 2
    out = resolve.merge(e, rel, ev, cl, r.mapping)
    assert {(x.source_id, x.target_id, x.type, x.weight) for x in out["relationships"].collect()} == {("e2", "e0", "W", 3.0), ("e2", "e2", "L", 1.0)}
    assert out["evidence"].count() == 1 and out["claims"].first().entity_id == "e0"
    assert {x.id: x.aliases for x in out["entities"].collect()} == {"e0": ["Acme"], "e2": []}


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "graph_name string, a string, b string, w double")


@pytest.mark.parametrize("local", [10**6, 0])
def test_two_pairs_are_two_communities(spark, local):
    e = edges_of(spark, [("g", "a", "b", 10.0), ("g", "c", "d", 10.0), ("g", "b", "c", 0.1)])
    m = communities.detect(e, 2, local_edges=local)
    level = {}
    for r in m.filter("level = 0").collect():
        level.setdefault(r.community_id, set()).add(r.entity_id)
    assert sorted(map(sorted, level.values())) == [["a", "b"], ["c", "d"]]
    assert m.count() >= 4


def test_communities_are_the_same_on_both_paths(spark):
    r, weights, gamma = np.random.default_rng(3), [0.5, 1.25, 2.0], 1.1
    rows = {(g, f"n{min(a, b)}", f"n{max(a, b)}") for g in ("g", "h") for a, b in r.integers(0, 60, (220, 2)) if a != b and (a // 12 == b // 12 or r.random() < 0.1)}
    e = edges_of(spark, [(*x, float(r.choice(weights))) for x in sorted(rows)])
    near = communities.detect(e, 2, gamma).collect()
    far = communities.detect(e, 2, gamma, local_edges=0).collect()
    assert sorted(near) == sorted(far)
    alone = communities.detect(e.filter("graph_name = 'g'"), 2, gamma).collect()
    assert sorted(alone) == sorted(x for x in near if x.graph_name == "g")
    # Connected inside, and of more modularity than a single community.
    links = {(g, a, b): w for g, a, b, w in [tuple(x) for x in e.collect()]}
    own = {(x.graph_name, x.entity_id): x.community_id for x in near if x.level == 0}
    for g in ("g", "h"):
        total = sum(w for (q, _, _), w in links.items() if q == g)
        k = {}
        for (q, a, b), w in links.items():
            if q == g:
                k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
        inside = sum(w for (q, a, b), w in links.items() if q == g and own[g, a] == own[g, b])
        size = {}
        for n, d in k.items():
            size[own[g, n]] = size.get(own[g, n], 0) + d
        assert inside / total - sum((x / 2 / total) ** 2 for x in size.values()) > 0.35
        for c in size:
            some = [n for n in k if own[g, n] == c]
            seen, todo = {some[0]}, [some[0]]
            while todo:
                n = todo.pop()
                for q, a, b in links:
                    for x, y in ((a, b), (b, a)):
                        if q == g and x == n and y in some and y not in seen:
                            seen.add(y)
                            todo.append(y)
            assert seen == set(some)


def test_communities_nest_and_repeat(spark):
    r = np.random.default_rng(3)
    rows = [("g", f"n{min(a, b):03}", f"n{max(a, b):03}", 1.0) for a, b in r.integers(0, 90, (400, 2)) if a != b and (a // 10 == b // 10 or r.random() < 0.1)]
    e = edges_of(spark, rows).groupBy("graph_name", "a", "b").agg(F.sum("w").alias("w"))
    m = communities.detect(e).collect()
    assert sorted(m) == sorted(communities.detect(e.repartition(3)).collect())
    levels = {}
    for x in m:
        levels.setdefault(x.level, {})[x.entity_id] = x.community_id
    for n in range(1, len(levels)):
        up = {}
        for k, c in levels[n - 1].items():
            assert up.setdefault(c, levels[n][k]) == levels[n][k]
    assert all(len(v) == len(levels[0]) for v in levels.values())


def test_hybrid_ranks(spark):
    v = spark.createDataFrame([("q", "a", 0.7), ("q", "b", 0.5)], "query_id string, id string, score double")
    k = spark.createDataFrame([("q", "a", 1.0), ("q", "c", 0.4)], "query_id string, id string, score double")
    rows = lambda df: [(r.id, r.score) for r in df.orderBy("rank").collect()]
    assert rows(search.hybrid(v, k)) == [("a", 1.0), ("b", 0.7142857142857143), ("c", 0.4)]
    assert rows(search.hybrid(v, k, ranker="linear", alpha=0.25)) == [("a", 1.0), ("c", 0.30000000000000004), ("b", 0.17857142857142858)]
    with pytest.raises(ValueError):
        search.hybrid(v, k, ranker="linear")


def test_assembly(spark):
    n = spark.createDataFrame([("d", f"c{c}", c, 0, "e1", "Person", "Al", x) for c, x in ((1, "first"), (2, " second "), (3, ""), (4, "first"))], "document_id string, chunk_id string, chunk_index int, pos int, node_id string, label string, name string, description string")
    assert assembly.entities(n, "g").first().name == "Al"
    assert assembly.descriptions(n, ["node_id"]).first().description == "first; second"
    r = assembly.relationships(n.withColumns({"source_id": F.lit("e1"), "target_id": F.lit("acme"), "type": F.lit("WORKS_AT")})).first()
    assert (r.observation_count, r.weight, r.source_chunk_ids) == (4, 4.0, ["c1", "c2", "c3", "c4"])


def test_schema_is_checked():
    with pytest.raises(ValueError):
        extraction.build_schema(["A", "A"])
    with pytest.raises(ValueError):
        extraction.build_schema(["A"], ["R"], [("A", "R", "B")])


class Twice:
    def __init__(self):
        self.n = 0

    def invoke(self, prompt):
        self.n += 1
        return ['{"nodes":[{"id":"a","label":"P"}]}', "Yes.", '{"nodes":[{"id":"a","label":"P"},{"id":"b","label":"P"}]}', "no"][self.n - 1]


def test_gleaning():
    assert [n["id"] for n in json.loads(extraction.Gleaning(Twice(), 3).invoke("x"))["nodes"]] == ["a", "b"]


def test_packing_skips_and_goes_on(spark):
    x = spark.createDataFrame([("g", 1, 3), ("g", 2, 5), ("g", 3, 1), ("g", 4, 4)], "g string, o int, n int")
    assert [r.included for r in context.pack_items(x, 8, "g", "o", "n").orderBy("o").collect()] == [True, True, False, False]


def test_map_answers():
    assert mapreduce.parse_map('```json\n{"helpfulness": "75", "answer": "x"}\n```')["helpfulness"] == 75
    assert mapreduce.parse_map('so {x {"helpfulness": 400} end')["helpfulness"] == 0
    with pytest.raises(ValueError):
        mapreduce.parse_map("nothing")


def test_citation_metadata(spark):
    c = spark.createDataFrame([("c", "d", 1, 2, "t" * 300, {"source": "row", "embedding": "x"})], "id string, document_id string, page_start int, page_end int, text string, metadata map<string,string>")
    d = spark.createDataFrame([("d", "T", {"source": "doc", "year": "1", "graph_name": "g"})], "id string, title string, metadata map<string,string>")
    r = traverse.citations(spark.createDataFrame([("c",), ("c",)], "chunk_id string"), c, d).collect()
    assert len(r) == 1 and r[0].metadata == {"source": "row", "year": "1"} and len(r[0].excerpt) == 200


def test_envelopes(spark):
    df = spark.createDataFrame([("a", None, {"source": "S 1"}), (None, [("p",), ("q",)], None)], "text string, pages array<struct<text:string>>, metadata map<string,string>")
    assert sorted(r.text for r in readers.envelopes(df).collect()) == ["a", "p\n\nq"]
    with pytest.raises(Exception, match="either text or pages"):
        readers.envelopes(spark.createDataFrame([("a", [("p",)])], "text string, pages array<struct<text:string>>")).collect()


def test_store_upserts(spark, tmp_path):
    s = store.GraphStore(spark, f"file://{tmp_path}/g")
    e = ents(spark, ["Alice"])
    assert s.write({"entities": e}) == {"entities": 1}
    s.write({"entities": e.withColumn("name", F.lit("Alicia"))})
    assert [r.name for r in s.table("entities").collect()] == ["Alicia"] and s.duplicates("entities").count() == 0
    rel = spark.createDataFrame([("g", "e0", "nobody", "R")], "graph_name string, source_id string, target_id string, type string")
    assert s.write({"relationships": rel}) == {"relationships": 0}
    assert s.sql("select count(*) n from entities where name = :x", x="Alicia").first().n == 1


PEOPLE = {"nodes": [{"id": "alice", "label": "Person", "properties": {"name": "Alice", "description": "An engineer."}}, {"id": "acme", "label": "Organization", "properties": {"name": "Acme"}}, {"id": "x", "label": "Alien"}], "relationships": [{"source_id": "alice", "target_id": "acme", "type": "WORKS_AT"}, {"source_id": "acme", "target_id": "alice", "type": "WORKS_AT"}]}


def answer(prompt):
    if "helpfulness" in prompt:
        return '{"answer": "Alice works at Acme", "helpfulness": 80}'
    if prompt.startswith("Report on"):
        ref = prompt.split("Ids that findings may refer to:\n")[1].split("\n")[0]
        return json.dumps({"title": "Work", "summary": "All work.", "rating": 5, "findings": [{"description": "works", "references": [{"target_id": ref, "target_type": "entity"}]}]})
    return json.dumps(PEOPLE) if prompt.startswith("Give the entities") else "An answer."


def test_engine_from_text_to_answers(spark, tmp_path):
    schema = extraction.build_schema(["Person", "Organization"], ["WORKS_AT"], [("Person", "WORKS_AT", "Organization")])
    e = Engine(spark, f"file://{tmp_path}/store", "g", schema, Scripted(answer), HashEmbedder())
    docs = spark.createDataFrame([("Alice works at Acme.", {"source": "one", "title": "One"})], "text string, metadata map<string,string>")
    assert e.build(docs) == {"documents": 1, "chunks": 1, "entities": 2, "evidence": 2, "relationships": 1}
    e.build(docs)
    assert e.counts()["entity_count"] == 2
    assert e.resolve(dry_run=True)["merged_groups"] == 0
    assert e.embed_entities() == 0
    assert e.detect().count() >= 1
    assert e.summarise() == 0
    local = e.search("Alice", "local")
    assert "Finding: Alice (Person)" in local.context and local.citations[0]["document_name"] == "One" and list(local.sources) == ["doc:one"]
    assert e.search("Alice", "drift").metadata["communities"] >= 1
    assert e.search("Alice", "global").citations
    with pytest.raises(ValueError):
        e.search("Alice", "other")


def graph_schema():
    return extraction.build_schema(["Person", "Organization"], ["WORKS_AT"], [("Person", "WORKS_AT", "Organization")])


def test_envelopes_of_pages_become_windows(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store", "g", graph_schema(), Scripted(answer))
    page = lambda t, **m: (t, m or None)
    pages = [page("one", record_id="r1", collection="c"), page("", record_id="r2", source="s2", collection="c"), page("three", id="x"), page(None)]
    rows = [("A text.", None, {"source": "text", "year": "1999"}), (None, pages, {"source": "book", "title": "Book"}), (None, [], {"source": "none"})]
    df = spark.createDataFrame(rows, "text string, pages array<struct<text:string,metadata:map<string,string>>>, metadata map<string,string>")
    assert e.build(df)["chunks"] == 4
    got = {r.id: r for r in e.store.table("chunks").collect()}
    assert sorted(got) == ["doc:book:pages:1-2", "doc:book:pages:2-3", "doc:book:pages:3-4", "doc:text:chunk:0"]
    first, text = got["doc:book:pages:1-2"], got["doc:text:chunk:0"]
    assert (first.text, first.page_start, first.page_end, first["index"]) == ("one\n\n", 1, 2, 0) and got["doc:book:pages:3-4"]["index"] == 2
    assert first.metadata == {"source": "book", "title": "Book", "page_start": "1", "page_end": "2", "record_ids": '["r1","r2"]', "source_ids": '["r1","s2"]', "collections": '["c"]'}
    assert text.metadata == {"source": "text", "year": "1999", "char_start": "0", "char_end": "7"} and text.page_start is None
    assert {r.document_id: (r.chunk_count, r.entity_count, r.relationship_count) for r in e.results(df).collect()} == {"doc:text": (1, 2, 1), "doc:book": (3, 2, 1), "doc:none": (0, 0, 0)}
    one = spark.createDataFrame([(["p", "q", "r"], {"source": "plain"})], "pages array<string>, metadata map<string,string>")
    e.build(one, window=1, window_overlap=0)
    assert {r.id for r in e.store.table("chunks").filter("document_id = 'doc:plain'").collect()} == {f"doc:plain:pages:{i}-{i}" for i in (1, 2, 3)}
    with pytest.raises(ValueError, match="window"):
        e.build(one, window=2, window_overlap=2)


class Counted:
    """A scripted model that notes what it was asked in a file, which workers share."""

    def __init__(self, path, answer):
        self.path, self.answer = path, answer

    def invoke(self, prompt):
        with open(self.path, "a") as f:
            f.write(json.dumps(prompt) + "\n")
        return self.answer(prompt)

    def asked(self):
        return [json.loads(x) for x in open(self.path)]


def test_models_are_asked_once(spark, tmp_path):
    def say(prompt):
        return '[{"subject": "alice", "description": "Alice is kind."}, {"subject": "nobody", "description": "x"}]' if prompt.startswith("Give the claims") else answer(prompt)

    chat = Counted(f"{tmp_path}/asked", say)
    e = Engine(spark, f"file://{tmp_path}/store", "g", graph_schema(), chat, prompts=extraction.Prompts(extract="Give the entities of {text} {not a name} by\n{schema}"))
    stats = e.build(spark.createDataFrame([("Alice works at Acme.", None)], "text string, metadata map<string,string>"), with_claims=True)
    assert stats["claims"] == 1 and len(chat.asked()) == 2
    assert any(p.startswith("Give the entities of Alice works at Acme. {not a name} by\n- Person") for p in chat.asked())
    assert e.counts() == {"entity_count": 2, "relationship_count": 1, "relationship_ends": 2, "self_loop_count": 0, "chunk_count": 1, "evidence_count": 2}


def test_reports_are_mended_once_and_keep_to_a_budget(spark, tmp_path):
    def say(prompt):
        if prompt.startswith("The report below"):
            return answer("Report on x" + prompt[prompt.index("\n\nIds that findings") :])
        return "No JSON." if prompt.startswith("Report on") else answer(prompt)

    chat = Counted(f"{tmp_path}/asked", say)
    e = Engine(spark, f"file://{tmp_path}/store", "g", graph_schema(), chat)
    e.build(spark.createDataFrame([("Alice works at Acme.",)], "text string"))
    e.detect()
    n = len(chat.asked())
    assert e.summarise(repair=False) == 1 and len(chat.asked()) == n + 1
    assert e.counts()["failed_report_count"] == 1
    assert e.summarise(concurrency=1) == 0 and len(chat.asked()) == n + 3
    assert "it isn't a JSON object" in chat.asked()[-1] and "No JSON." in chat.asked()[-1]
    assert (e.counts()["community_summary_count"], e.counts()["failed_report_count"]) == (1, 0)
    assert e.summarise() == 0 and len(chat.asked()) == n + 3
    assert e.summarise(skip_existing=False, max_tokens=4) == 0
    asked = [p for p in chat.asked()[n + 3 :] if p.startswith("Report on")]
    assert len(asked) == 1 and "WORKS_AT" not in asked[0].split("Ids that")[0]


def test_problems_of_reports(spark):
    good = {"title": "T", "summary": "S", "rating": 3, "findings": [{"description": "d", "references": [{"target_id": "a", "target_type": "entity"}]}]}
    rows = [json.dumps(good), json.dumps(good | {"title": ""}), json.dumps(good | {"rating": "high"}), json.dumps(good | {"findings": []}), "nothing"]
    df = spark.createDataFrame([(i, r, ["a"]) for i, r in enumerate(rows)], "i int, content string, ids array<string>")
    got = [r.p for r in df.select("i", context.report_problems(F.col("content"), F.col("ids")).alias("p")).orderBy("i").collect()]
    assert got[0] == "" and got[1] == "it has no title" and "rating" in got[2] and got[3].startswith("no finding") and "JSON" in got[4]
    parsed = context.parse_report(F.col("content"), F.col("ids"), F.lit("c"), F.lit(0))
    js = [r.j for r in df.select("i", context.report_json(parsed).alias("j")).orderBy("i").collect()]
    assert json.loads(js[0])["findings"][0]["references"] == [{"target_id": "a", "target_type": "entity"}] and list(json.loads(js[0])) == sorted(json.loads(js[0])) and js[4] is None


def test_children_in_a_budget(spark):
    x = spark.createDataFrame([("p", 1, "a", 0, "x" * 60), ("p", 1, "b", 0, "y" * 60), ("q", 1, "c", 0, "z")], "parent_id string, parent_level int, child_id string, level int, summary string")
    got = {r.community_id: r.text for r in context.child_context(x).collect()}
    assert got["p"] == "Community a (level 0):\n" + "x" * 60 + "\n\nCommunity b (level 0):\n" + "y" * 60
    small = {r.community_id: r.text for r in context.child_context(x, 25).collect()}
    assert small["p"] == "Community a (level 0):\n" + "x" * 60 + "\n\nCommunity b (lev" and small["q"] == got["q"]


def test_packing_cuts_what_is_too_long(spark):
    x = spark.createDataFrame([("g", 1, 3, "a" * 12), ("g", 2, 9, "b" * 36), ("g", 3, 2, "c" * 8), ("g", 4, 1, "d")], "g string, o int, n int, t string")
    got = context.pack_items(x, 8, "g", "o", "n", "t").orderBy("o").collect()
    assert [(r.included, r.truncated, r.n, r.t) for r in got] == [(True, False, 3, "a" * 12), (True, True, 5, "b" * 20), (False, False, 0, ""), (False, False, 0, "")]


def test_vector_search_by_blocks(spark, monkeypatch):
    r = np.random.default_rng(5)
    x, q = r.normal(size=(300, 8)), r.normal(size=(9, 8))
    x[7] = x[3]
    index = search.unit_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 8), (901, None), (902, [1.0, 2.0])], "id int, embedding array<double>")).repartition(5)
    asks = search.unit_vectors(spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)] + [("other", [2.0, 1.0])], "query_id string, embedding array<double>"))
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    want = {(f"q{a}", int(b)): round(s[a, b], 9) for a in range(9) for b in np.lexsort((np.arange(300), -np.round(s[a], 12)))[:4]} | {("other", 902): 0.8}
    for size in (search.QUERY_BYTES, 64 * 2):
        monkeypatch.setattr(search, "QUERY_BYTES", size)
        assert {(r.query_id, r.id): round(r.score, 9) for r in search.vector_search(index, asks, 4).collect()} == pytest.approx(want)
    assert search.vector_search(index, asks.limit(0), 4).count() == 0
    plan = search.vector_search(index, asks, 4)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_keyword_search_of_texts_and_of_an_index(spark):
    names = spark.createDataFrame([(i, t) for i, t in enumerate(["red apple", "green apple apple", "red", "", None, "blue sky"])], "id int, name string")
    q = spark.createDataFrame([("a", "Apple red"), ("b", "nothing"), ("c", "")], "query_id string, text string")
    rows = lambda df: [(r.query_id, r.id, round(r.score, 9)) for r in df.orderBy("query_id", "rank").collect()]
    assert rows(search.bm25(search.postings(names), q)) == rows(search.bm25_texts(names, q)) and [r[1] for r in rows(search.bm25_texts(names, q))] == [0, 2, 1]


def test_a_crash_between_renames_loses_no_table(spark, tmp_path):
    s = store.GraphStore(spark, f"file://{tmp_path}/g")
    s.write({"entities": ents(spark, ["Alice"])})
    s.create_indexes()
    assert s.exists("index_names") and [r.graph_name for r in s.table("index_names").collect()] == ["g"]
    (tmp_path / "g" / "entities").rename(tmp_path / "g" / "_entities_aside")
    assert s.table("entities").count() == 1 and s.verify("g").count() == 1
    s.write({"entities": ents(spark, ["Alice", "Bob"])})
    assert not s.exists("index_names")
    v = lambda rows: spark.createDataFrame([("g", *r) for r in rows], "graph_name string, id string, embedding array<float>")
    with pytest.raises(ValueError, match="lengths"):
        s.upsert_vectors(v([("e0", [1.0]), ("e1", [1.0, 2.0])]))
    s.upsert_vectors(v([("e0", [1.0, 0.0])]))
    with pytest.raises(ValueError, match="lengths"):
        s.upsert_vectors(v([("e1", [1.0])]))
    assert s.unembedded("g").count() == 1
    s.delete_communities("g")


def test_artifacts_lines_and_runs(spark, tmp_path):
    at = f"file://{tmp_path}"
    tables = {"entities": ents(spark, ["Alice", "Bob"]), "claims": spark.createDataFrame([("g", "c1", "e0")], "graph_name string, id string, entity_id string")}
    store.save_artifact(tables, f"{at}/artifact")
    schemas = {name: ", ".join(f"{c} {t}" for c, t in df.dtypes) for name, df in tables.items()}
    back = store.load_artifact(spark, f"{at}/artifact", schemas | {"missing": "a string"})
    assert set(back) == set(tables) and all(sorted(back[n].collect()) == sorted(df.collect()) for n, df in tables.items())
    (tmp_path / "lines.json").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert sorted((r.a, r.b) for r in readers.json_lines(spark, f"{at}/lines.json", "a int, b string").collect()) == [(1, "x"), (2, None)]
    readers.write_run(spark.createDataFrame([(1, "answer")], "id int, text string"), {"model": "fake", "at": 3}, f"{at}/run")
    assert spark.read.json(f"{at}/run/results").first().text == "answer"
    assert json.loads(spark.read.text(f"{at}/run/manifest").first().value) == {"at": 3, "model": "fake"}


def test_claims_need_their_entity(spark, tmp_path):
    s = store.GraphStore(spark, f"file://{tmp_path}/g")
    claims = spark.createDataFrame([("g", "c1", "e0", "k"), ("g", "c2", "nobody", "k")], "graph_name string, id string, entity_id string, claim_type string")
    assert s.write({"entities": ents(spark, ["Alice"]), "claims": claims}) == {"entities": 1, "claims": 1}


def test_levels(spark):
    c = spark.createDataFrame([(0, "a"), (2, "b")], "level int, id string")
    assert [communities.level_of(c, x) for x in (None, "all", "finest", "coarsest", 1)] == [None, None, 0, 2, 1]
    for bad in (-1, True, "middle"):
        with pytest.raises(ValueError):
            communities.level_of(c, bad)
    p = spark.createDataFrame([(["a", "a", "b"], "b"), ([], "c")], "p array<string>, l string")
    assert [r.x for r in p.select(communities.normal_path(F.col("p"), F.col("l")).alias("x")).collect()] == [["a", "b"], ["c"]]


def test_all_chunks_failing_is_an_error(spark):
    def fail(prompt):
        raise RuntimeError("down")

    c = spark.createDataFrame([("c", "t")], "chunk_id string, text string")
    with pytest.raises(RuntimeError, match="down"):
        extraction.check_errors(extraction.extract(c, extraction.build_schema(["A"]), Scripted(fail)))
    assert FakeChat().invoke("x") == FakeChat().invoke("x")


def test_answers_are_numbered_in_many_tasks(spark):
    """No window without keys, which would sort all rows in one task; the same places."""
    rows = [(f"b{i * 7919 % 1000:04}", f"a{i}", (i * 31) % 101, [f"r{i % 7}", f"r{i % 3}"], [("entity", f"e{i % 11}")], [f"r{i % 3}", "r9"], None) for i in range(1000)]
    x = spark.createDataFrame(rows, "batch_id string, answer string, helpfulness int, report_ids array<string>, references array<struct<target_type:string,target_id:string>>, batch_report_ids array<string>, error string").repartition(5)
    got = mapreduce.scored(x)
    order = sorted((r for r in rows if r[2] > 0), key=lambda r: (-r[2], r[0]))
    assert [(r.place, r.batch_id) for r in sorted(got.collect(), key=lambda r: r.place)] == [(i + 1, r[0]) for i, r in enumerate(order)]
    assert dict(got.dtypes)["place"] == "int"
    first = {}
    for i, r in enumerate(order):
        for name in [n for n in dict.fromkeys(r[3]) if n in r[5]] or r[5]:
            first.setdefault(name, i + 1)
    used = mapreduce.used_reports(got)
    assert {r.report_id: r.place for r in used.collect()} == first
    refs = mapreduce.all_references(got.select("place", F.explode("references").alias("r")).select("place", "r.*"), spark.createDataFrame([("entity", "e99", 1), ("claim", "e0", 2), ("thing", "x", 1)], "target_type string, target_id string, place int"))
    assert [r.target_id for r in sorted(refs.collect(), key=lambda r: r.pos)][-2:] == ["e99", "e0"] and refs.count() == 13
    few = sorted(mapreduce.reduce_texts(got, 30).collect(), key=lambda r: r.place)
    assert [r.place for r in few] == list(range(1, len(few) + 1)) and sum(r.tokens for r in few) <= 30 < sum(r.tokens for r in few) + few[-1].tokens + 1
    for df in (got, used, refs):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan


def test_edges_beside_communities_are_not_shuffled(spark):
    """What can't be inside of a community is dropped where edges are made, not by the join."""
    edges = spark.range(3000).select(F.lit("g").alias("graph_name"), F.concat(F.lit("c"), F.col("id") % 40).alias("source_id"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("c"), F.col("id") % 7)).otherwise(F.concat(F.lit("p"), "id")).alias("target_id"), F.lit("T").alias("type"))
    edges = edges.groupBy("graph_name", "source_id", "target_id", "type").agg(F.count("*").cast("double").alias("weight"))
    members = spark.range(40).select(F.lit("g").alias("graph_name"), F.concat(F.lit("c"), "id").alias("entity_id"), F.lit("k").alias("community_id"), F.lit(0).alias("level"))
    got = traverse.within(edges, members)
    want = {(r.source_id, r.target_id) for r in edges.collect() if r.target_id.startswith("c") and r.source_id != r.target_id}
    assert {(r.source_id, r.target_id) for r in got.collect()} == want and want
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    first = lambda s: next(i for i, x in enumerate(lines) if s in x)
    assert first("Aggregate [") < first("might_contain(")
    kept = edges.filter(traverse.might_be("target_id", members.select("entity_id"))).count()
    assert len(want) <= kept < 300
    d = {r.id: r.degree for r in traverse.degrees(edges).collect()}
    some = {r.id: r.degree for r in traverse.degrees(edges, among=members.select("entity_id")).collect()}
    assert {k: v for k, v in d.items() if k.startswith("c")}.items() <= some.items() <= d.items() and len(some) < len(d) / 5
    assert traverse.within(edges, members.limit(0)).count() == 0


def test_own_names_join_lines_that_are_sets(spark):
    """An entity's lines meet its name once they are a set; ids of several graphs and repeated matches count once."""
    e = spark.createDataFrame([("g", "a", "T", "A", ""), ("h", "a", "T", "B", ""), ("g", "b", "T", "C", "")], "graph_name string, id string, type string, name string, description string")
    r = spark.createDataFrame([("g", "a", "b", "X", 1.0), ("g", "a", "b", "X", 2.0)], "graph_name string, source_id string, target_id string, type string, weight double")
    none = spark.createDataFrame([], "chunk_id string, entity_id string"), spark.createDataFrame([], "id string, text string")
    m = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "id string, score double")
    got = traverse.local_context(m, e, r, *none)
    assert {tuple(x.relationships) for x in got.collect()} == {("T: A -[X]-> T: C", "T: B -[X]-> T: C")} and got.count() == 4
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # Above the sets: the name is joined to them.
    assert next(i for i, x in enumerate(lines) if "_own" in x and "Join" not in x and "transform" in x) < next(i for i, x in enumerate(lines) if "collect_set(concat( -[" in x)


def test_vocabularies_are_not_joined_by_shuffles(spark):
    """By a shuffle, all nodes of one of a few labels meet in one task."""
    schema = extraction.build_schema(["A", "B"], ["T"], [("A", "T", "B")])
    x = spark.createDataFrame([("c1", '{"nodes":[{"id":"1","label":"A"},{"id":"2","label":"B"},{"id":"3","label":"C"}],"relationships":[{"source_id":"1","target_id":"2","type":"T"},{"source_id":"2","target_id":"1","type":"T"}]}')], "chunk_id string, content string")
    x = x.withColumn("p", extraction.parse_items(F.col("content"))).select("chunk_id", "p.nodes", "p.relationships")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    nodes = extraction.valid_nodes(x, schema.labels(spark))
    rels = extraction.valid_relationships(x, nodes, schema)
    assert sorted(r.node_id for r in nodes.collect()) == ["1", "2"] and [(r.source_id, r.target_id) for r in rels.collect()] == [("1", "2")]
    assert "hashpartitioning(label" not in plan(nodes) and "hashpartitioning(source_label" not in plan(rels) and "hashpartitioning(label" not in plan(rels)


def test_scores_that_differ_in_their_last_bits_tie(spark):
    v = spark.createDataFrame([("q", "z", 1.0), ("q", "b", 0.1 + 0.2), ("q", "a", 0.3)], "query_id string, id string, score double")
    got = search.hybrid(v, v.limit(0), 2).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.rank)] == ["z", "a"]
    # The same sums in another order: `_scored` adds up what a shuffle brings.
    hits = spark.createDataFrame([(t, i, 4, 1) for i in (1, 2) for t in ("a", "b", "c")], "term string, id int, length int, tf int").withColumn("tf", F.when((F.col("id") == 1) & (F.col("term") == "a"), F.lit(1.0 - 1e-14)).otherwise(F.lit(1.0)))
    terms = spark.createDataFrame([("q", t) for t in ("a", "b", "c")], "query_id string, term string")
    docs = spark.createDataFrame([(9, 4.0)], "n bigint, mean double")
    assert search._scored(hits, terms, docs, 1).first().id == 1


def test_communities_are_the_same_with_shared_nodes(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(g, f"n{x:02}", f"n{y:02}", float(w)) for g, n in (("g", 60), ("h", 9), ("i", 2)) for x, y, w in zip(r.integers(0, n, 4 * n).tolist(), r.integers(0, n, 4 * n).tolist(), r.integers(1, 5, 4 * n).tolist(), strict=True) if x < y]
    e = spark.createDataFrame(rows + [("h", f"z{i}", f"z{i + 1}", 2.0) for i in range(40)], "graph_name string, a string, b string, w double").groupBy("graph_name", "a", "b").agg(F.sum("w").alias("w"))
    monkeypatch.setattr(communities, "PART_ENDS", 50)
    for levels, gamma in ((3, 1.0), (2, 3.0)):
        near = sorted(communities.detect(e, levels, gamma).collect())
        # Not by the plans whose rounds take about a second each and more.
        monkeypatch.setattr(communities, "_distributed", None)
        assert sorted(communities.detect(e, levels, gamma, local_edges=0).collect()) == near and len({x.level for x in near}) > 1
        monkeypatch.undo()
        monkeypatch.setattr(communities, "PART_ENDS", 50)
        one = e.filter("graph_name = 'g'")
        assert sorted(communities.detect(one, levels, gamma, local_edges=0, shared_nodes=0).collect()) == sorted(communities.detect(one, levels, gamma).collect())
