"""Community hierarchies by multilevel modularity.

At each level nodes move, all at once but by halves drawn by hash, to the neighbouring community of the greatest gain;
communities that fell apart are split into connected parts; parts become the nodes of the next level. The same steps
run in numpy, a graph a task, where no graph has more than LOCAL_EDGES edges; in numpy too, edges by ranges of nodes in
tasks and some numbers of each node shared by all, up to SHARED_NODES nodes; and as DataFrame plans beyond, with the same
result: gains are rounded alike, ties go to the lesser id, and a half is a bit of the hash of a node's name (of its least
member's, for a community) that the seed and the round choose.

Entities without edges are in no community. Loops and edges with a null end are left out, null weights count 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.lineage import cut, cut_bare, numbered, ship

LOCAL_EDGES = 2_000_000
#: Nodes that are numbered and shared, about 25 bytes of each in a task; ends of edges that a task works on at once.
SHARED_NODES, PART_ENDS = 1 << 24, 1 << 20
ROUNDS = 24
PATHS = "graph_name string, entity_id string, level int, community_id string"


def project(relationships: DataFrame, types: list[str] | None = None, weight: str | None = "weight") -> DataFrame:
    """Undirected edges (graph_name, a, b, w), a < b, parallel ones added up; an error where nothing is left."""
    have = {r["type"] for r in relationships.select("type").distinct().collect()}
    chosen = sorted(have - {"IN_COMMUNITY", "PARENT_COMMUNITY"} if types is None else have & set(types))
    if not chosen:
        raise ValueError("no relationship of a type that counts")
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    x = relationships.filter(F.col("type").isin(chosen)).filter("source_id != target_id")
    return x.groupBy("graph_name", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.sum(w).alias("w"))


def _bit(seed: int, r: int) -> int:
    """The bit of nodes' hashes that halves them in a round."""
    return (seed + r) % 64


def _move(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, loop: np.ndarray, gamma: float, tolerance: float, seed: int, hashes: np.ndarray) -> np.ndarray:
    """Communities of the nodes 0 .. n - 1."""
    src, dst, ww = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    k = np.bincount(src, ww, n) + 2 * loop
    total = k.sum()
    own = np.arange(n)
    quiet = 0
    for r in range(ROUNDS):
        size = np.bincount(own, k, n)
        key, at = np.unique(src * n + own[dst], return_inverse=True)
        node, to = key // n, key % n
        link = np.bincount(at, ww)
        gain = np.round(link - gamma * k[node] * (size[to] - np.where(own[node] == to, k[node], 0)) / total, 12)
        stay = np.round(-gamma * k * (size[own] - k) / total, 12)
        same = own[node] == to
        stay[node[same]] = gain[same]
        order = np.lexsort((to, -gain, node))
        first = order[np.flatnonzero(np.diff(node[order], prepend=-1))]
        better = gain[first] > stay[node[first]] + tolerance * 1e-3
        half = ((hashes[node[first]] >> _bit(seed, r)) & 1).astype(bool)
        go = first[better & half]
        quiet = 0 if better.any() else 1
        own = own.copy()
        own[node[go]] = to[go]
        if quiet:
            break
    # Split what isn't connected inside.
    label = np.arange(n)
    inside = own[a] == own[b]
    x, y = a[inside], b[inside]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def hierarchy(a: np.ndarray, b: np.ndarray, w: np.ndarray, ha: np.ndarray, hb: np.ndarray, max_levels: int = 3, gamma: float = 1.0, tolerance: float = 1e-4, seed: int = 42) -> tuple[np.ndarray, list[np.ndarray]]:
    """Nodes, sorted, and for each level, finest first, the place of the least node of each one's community. ha, hb: 64-bit
    hashes of the names a, b, which tell them apart."""
    hashes, one, at = np.unique(np.concatenate([ha, hb]), return_index=True, return_inverse=True)
    nodes = np.concatenate([a, b])[one].astype(str)
    by = np.argsort(nodes)
    nodes, hashes, place = nodes[by], hashes[by], np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    at = place[at]
    x, y, w = at[: len(a)], at[len(a) :], np.asarray(w, np.float64)
    loop = np.zeros(len(nodes))
    top, own_hash = np.arange(len(nodes)), hashes
    levels: list[np.ndarray] = []
    for _ in range(max_levels):
        label = _move(len(loop), x, y, w, loop, gamma, tolerance, seed, own_hash)
        kept, small = np.unique(label, return_inverse=True)
        if levels and len(kept) == len(label):
            break
        top = small[top]
        least = np.full(len(kept), len(nodes))
        np.minimum.at(least, top, np.arange(len(nodes)))
        levels.append(least[top])
        own_hash = hashes[least]
        inner = small[x] == small[y]
        loop = np.bincount(small, loop, len(kept)) + np.bincount(small[x[inner]], w[inner], len(kept))
        p, q = np.minimum(small[x], small[y])[~inner], np.maximum(small[x], small[y])[~inner]
        key, at = np.unique(p * len(kept) + q, return_inverse=True)
        w = np.bincount(at, w[~inner], len(key)) if len(key) else np.zeros(0)
        x, y = key // len(kept), key % len(kept)
        if not len(x):
            break
    return nodes, levels


def detect(edges: DataFrame, max_levels: int = 3, gamma: float = 1.0, tolerance: float = 1e-4, seed: int = 42, local_edges: int = LOCAL_EDGES, shared_nodes: int = SHARED_NODES) -> DataFrame:
    """Memberships (graph_name, entity_id, level, community_id) of projected edges; level 0 is the finest. A community is
    named by its level and its least member."""
    ship(edges.sparkSession)
    edges = cut(edges.select("graph_name", "a", "b", "w"))
    n = edges.groupBy("graph_name").count().agg(F.max("count")).first()[0]
    if not n:
        raise ValueError("communities need edges")
    if n > local_edges:
        nodes = numbered(edges.select("graph_name", F.col("a").alias("n")).union(edges.select("graph_name", "b")).distinct(), ["graph_name", "n"], "id", 0)
        if nodes.count() <= shared_nodes:
            return _shared(edges, nodes, max_levels, gamma, tolerance, seed)
        return _distributed(edges, max_levels, gamma, tolerance, seed)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, levels = hierarchy(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["w"].to_numpy(), pdf["ha"].to_numpy(), pdf["hb"].to_numpy(), max_levels, gamma, tolerance, seed)
        out = [pd.DataFrame({"entity_id": nodes, "level": i, "community_id": np.char.add(f"{i}:", nodes[at])}) for i, at in enumerate(levels)]
        x = pd.concat(out)
        x.insert(0, "graph_name", pdf["graph_name"].iloc[0])
        return x

    return edges.withColumns({"ha": F.xxhash64("a"), "hb": F.xxhash64("b")}).groupBy("graph_name").applyInPandas(run, PATHS)


def _edges_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) // 16
    return np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.int32, n, 4 * n), np.frombuffer(raw, np.float64, n, 8 * n)


def _blob(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> bytes:
    return src.astype(np.int32).tobytes() + dst.astype(np.int32).tobytes() + w.astype(np.float64).tobytes()


def _added(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges by source and target, parallel ones added up."""
    key, at = np.unique(src.astype(np.int64) * n + dst, return_inverse=True)
    return key // n, key % n, np.bincount(at, w, len(key))


def _parts(n: int):
    """Of a range of nodes: its edges, each once."""

    def run(table: pa.Table) -> pa.Table:
        if "blob" in table.column_names:
            src, dst, w = (np.concatenate(x) for x in zip(*(_edges_of(r.as_py()) for r in table.column("blob")), strict=True))
        else:
            src, dst, w = (table.column(c).to_numpy() for c in ("src", "dst", "w"))
        return pa.table({"part": table.column("part").slice(0, 1), "blob": pa.array([_blob(*_added(src, dst, w, n))], pa.binary())})

    return run


def _per_part(parts: DataFrame, of: Callable, shared: tuple) -> list[np.ndarray]:
    """What a function of (edges, shared) gives for each part, an array or several, put together on the driver."""
    b: Broadcast = parts.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(batch.schema.get_field_index("blob")):
                yield pa.RecordBatch.from_arrays([pa.array([[x.tobytes() for x in of(*_edges_of(raw.as_py()), *b.value)]], pa.list_(pa.binary()))], ["found"])

    found = [r.found for r in parts.mapInArrow(run, "found array<binary>").collect()]
    b.destroy()
    return [b"".join(x) for x in zip(*found, strict=True)]


def _shared(edges: DataFrame, nodes: DataFrame, max_levels: int, gamma: float, tolerance: float, seed: int) -> DataFrame:
    """The driver has some numbers of each node and hands them out each round; edges stay where they are, by ranges of nodes."""
    g = "graph_name"
    named = nodes.select("id", F.xxhash64("n").alias("h")).toArrow()
    n = n0 = named.num_rows
    hashes = np.empty(n, np.int64)
    hashes[named.column("id").to_numpy()] = named.column("h").to_numpy()
    counts = [r["count"] for r in nodes.groupBy(g).count().orderBy(g).collect()]
    graph = graph0 = np.repeat(np.arange(len(counts)), counts)
    of = lambda end, to: nodes.select(g, F.col("n").alias(end), F.col("id").cast("int").alias(to))
    e = edges.join(of("a", "src"), [g, "a"]).join(of("b", "dst"), [g, "b"])
    both = e.select("src", "dst", "w").union(e.select("dst", "src", "w"))
    many = 2 * edges.count() // PART_ENDS + 1
    both = both.withColumn("part", F.expr(f"cast(src * {many}L div {n} as int)"))
    parts = cut(both.groupBy("part").applyInArrow(_parts(n), "part int, blob binary"))
    top, own_hash, loop, alive, levels = np.arange(n), hashes, np.zeros(n), np.ones(len(counts), np.bool_), []
    for level in range(max_levels):
        node, weight = _per_part(parts, _weights, ())
        node, weight = np.frombuffer(node, np.int32), np.frombuffer(weight, np.float64)
        has = np.zeros(len(counts), np.bool_)
        has[graph[node]] = True
        alive &= has
        if not alive.any():
            break
        k = np.bincount(node, weight, n) + 2 * loop
        total = np.bincount(graph, k, len(counts))[graph] if len(counts) > 1 else k.sum()
        own = np.arange(n, dtype=np.int32)
        for r in range(ROUNDS):
            half = ((own_hash >> _bit(seed, r)) & 1).astype(bool)
            go, to, better = _per_part(parts, _moves(gamma, tolerance), (own, np.bincount(own, k, n), k, total, half))
            own[np.frombuffer(go, np.int32)] = np.frombuffer(to, np.int32)
            if not any(better):
                break
        label = np.arange(n, dtype=np.int32)
        while True:
            node, low = (np.frombuffer(x, np.int32) for x in _per_part(parts, _lows, (own, label)))
            if not len(node):
                break
            new = label.copy()
            np.minimum.at(new, label[node], low)
            np.minimum.at(new, node, low)
            while not np.array_equal(new, new[new]):
                new = new[new]
            label = new
        kept, small = np.unique(label, return_inverse=True)
        merged = np.bincount(graph[kept], minlength=len(counts)) < np.bincount(graph, minlength=len(counts))
        if level:
            alive &= merged
            if not alive.any():
                break
        small = small.astype(np.int32)
        top = small[top]
        least = np.full(len(kept), n0)
        np.minimum.at(least, top, np.arange(n0))
        levels.append(np.where(alive[graph0], least[top], -1))
        if level == max_levels - 1:
            break
        many = min(many, len(kept))
        shared = parts.sparkSession.sparkContext.broadcast(small)
        folded = cut(parts.mapInArrow(_folded(shared, len(kept), many), "part int, blob binary"))
        shared.destroy()
        loop = np.bincount(small, loop, len(kept))
        for r in folded.filter("part < 0").select("blob").collect():
            p, _, w = _edges_of(r.blob)
            loop += np.bincount(p, w, len(kept))
        graph, own_hash, n = graph[kept], hashes[least], len(kept)
        parts = cut(folded.filter("part >= 0").groupBy("part").applyInArrow(_parts(n), "part int, blob binary"))
    shared = parts.sparkSession.sparkContext.broadcast(levels)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, at in enumerate(shared.value):
                to = at[batch.column(2).to_numpy()]
                some = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(batch), i, np.int32)), pa.array(to)], ["graph_name", "entity_id", "level", "least"])
                yield some.filter(pa.array(to >= 0))

    found = cut(nodes.select(g, "n", "id").mapInArrow(rows, "graph_name string, entity_id string, level int, least bigint"))
    shared.destroy()
    names = found.select("least").distinct().join(nodes.select(F.col("id").alias("least"), "n"), "least")
    return found.join(names, "least").select(g, "entity_id", "level", F.concat(F.col("level").cast("string"), F.lit(":"), "n").alias("community_id"))


def _weights(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Nodes and the weights of their edges."""
    begin = np.flatnonzero(np.diff(src, prepend=-1))
    return [src[begin], np.add.reduceat(w, begin) if len(begin) else w]


def _moves(gamma: float, tolerance: float) -> Callable:
    def run(src: np.ndarray, dst: np.ndarray, w: np.ndarray, own: np.ndarray, size: np.ndarray, k: np.ndarray, total: np.ndarray | float, half: np.ndarray) -> list[np.ndarray]:
        """Nodes that move and where to; would any? As in _move()."""
        node, to, link = _added(src, own[dst], w, len(own))
        of = (lambda x: total[x]) if isinstance(total, np.ndarray) else (lambda x: total)
        same = own[node] == to
        gain = np.round(link - gamma * k[node] * (size[to] - np.where(same, k[node], 0)) / of(node), 12)
        order = np.lexsort((to, -gain, node))
        first = order[np.flatnonzero(np.diff(node[order], prepend=-1))]
        x = node[first]
        stay = np.round(-gamma * k[x] * (size[own[x]] - k[x]) / of(x), 12)
        mine = np.flatnonzero(same)
        stay[np.searchsorted(x, node[mine])] = gain[mine]
        better = gain[first] > stay + tolerance * 1e-3
        go = first[better & half[x]]
        return [node[go].astype(np.int32), to[go].astype(np.int32), np.array([better.any()])]

    return run


def _lows(src: np.ndarray, dst: np.ndarray, w: np.ndarray, own: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Nodes with a lesser label than their own beside them in their community, and the least one."""
    inside = own[src] == own[dst]
    src, dst = src[inside], dst[inside]
    begin = np.flatnonzero(np.diff(src, prepend=-1))
    low = np.minimum.reduceat(label[dst], begin) if len(begin) else label[:0]
    less = low < label[src[begin]]
    return [src[begin][less], low[less]]


def _folded(shared: Broadcast, n: int, many: int):
    """Edges of the next level, by part; in part -1 those inside of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(batch.schema.get_field_index("blob")):
                src, dst, w = _edges_of(raw.as_py())
                p, q = shared.value[src], shared.value[dst]
                inner, once = p == q, src < dst
                x, y, v = _added(p[~inner], q[~inner], w[~inner], n)
                part = x * many // n
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                names, blobs = part[cuts].tolist(), [_blob(x[a:b], y[a:b], v[a:b]) for a, b in zip(cuts, np.append(cuts, len(x))[1:], strict=True)]
                i = inner & once
                yield pa.RecordBatch.from_arrays([pa.array([-1, *names], pa.int32()), pa.array([_blob(*_added(p[i], q[i], w[i], n)), *blobs], pa.binary())], ["part", "blob"])

    return run


def _distributed(edges: DataFrame, max_levels: int, gamma: float, tolerance: float, seed: int) -> DataFrame:
    g = "graph_name"
    current = edges
    loops = cut_bare(current.select(g, F.col("a").alias("n"), F.lit(0.0).alias("loop")).union(current.select(g, "b", F.lit(0.0))).distinct())
    paths, out = None, None
    for level in range(max_levels):
        both = current.select(g, F.col("a").alias("n"), F.col("b").alias("o"), "w").union(current.select(g, "b", "a", "w"))
        k = both.groupBy(g, "n").agg(F.sum("w").alias("k0"))
        state = cut_bare(loops.join(k, [g, "n"], "left").select(g, "n", (F.coalesce("k0", F.lit(0.0)) + 2 * F.col("loop")).alias("k"), F.col("n").alias("c")))
        total = state.groupBy(g).agg(F.sum("k").alias("total"))
        for r in range(ROUNDS):
            size = state.groupBy(g, "c").agg(F.sum("k").alias("size"))
            link = both.join(state.select(g, F.col("n").alias("o"), F.col("c").alias("to")), [g, "o"]).groupBy(g, "n", "to").agg(F.sum("w").alias("link"))
            own = state.select(g, "n", F.col("c").alias("to"), F.lit(0.0).alias("link"))
            x = link.union(own).groupBy(g, "n", "to").agg(F.sum("link").alias("link")).join(state, [g, "n"]).join(size.withColumnRenamed("c", "to"), [g, "to"]).join(total, g)
            gain = F.round(F.col("link") - gamma * F.col("k") * (F.col("size") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)) / F.col("total"), 12)
            best = x.groupBy(g, "n", "k", "c").agg(F.max(F.when(F.col("to") == F.col("c"), gain)).alias("stay"), F.min(F.struct((-gain).alias("l"), F.col("to"))).alias("b"))
            better = -F.col("b.l") > F.col("stay") + tolerance * 1e-3
            new = cut_bare(best.select(g, "n", "k", F.when(better & (F.shiftrightunsigned(F.xxhash64("n"), _bit(seed, r)).bitwiseAND(F.lit(1)) == 1), F.col("b.to")).otherwise(F.col("c")).alias("c"), better.alias("better")))
            state = new.drop("better")
            if not new.filter("better").limit(1).count():
                break
        inside = current.join(state.select(g, F.col("n").alias("a"), F.col("c").alias("ca")), [g, "a"]).join(state.select(g, F.col("n").alias("b"), F.col("c").alias("cb")), [g, "b"]).filter("ca = cb")
        label = state.select(g, "n", F.col("n").alias("l"))
        pairs = cut_bare(inside.select(g, F.col("a").alias("n"), F.col("b").alias("o")).union(inside.select(g, "b", "a")))
        while True:
            low = pairs.join(label.select(g, F.col("n").alias("o"), F.col("l").alias("lo")), [g, "o"]).groupBy(g, "n").agg(F.min("lo").alias("lo"))
            new = cut_bare(label.join(low, [g, "n"], "left").select(g, "n", F.least("l", "lo").alias("l"), (F.col("lo") < F.col("l")).alias("changed")))
            label = new.drop("changed")
            if not new.filter("changed").limit(1).count():
                break
        paths = label.select(g, F.col("n").alias("entity_id"), F.col("l").alias("c")) if paths is None else paths.join(label.select(g, F.col("n").alias("c"), "l"), [g, "c"]).select(g, "entity_id", F.col("l").alias("c"))
        paths = cut_bare(paths)
        rows = paths.select(g, "entity_id", F.lit(level).alias("level"), F.concat(F.lit(f"{level}:"), "c").alias("community_id"))
        if out is not None and label.filter("n != l").limit(1).count() == 0:
            break
        out = rows if out is None else out.unionByName(rows)
        at = lambda c, to: label.select(g, F.col("n").alias(c), F.col("l").alias(to))
        moved = current.join(at("a", "p"), [g, "a"]).join(at("b", "q"), [g, "b"])
        inner = moved.filter("p = q").groupBy(g, F.col("p").alias("l")).agg(F.sum("w").alias("inner"))
        loops = cut_bare(loops.join(at("n", "l"), [g, "n"]).groupBy(g, "l").agg(F.sum("loop").alias("loop")).join(inner, [g, "l"], "left").select(g, F.col("l").alias("n"), (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop")))
        current = cut_bare(moved.filter("p != q").groupBy(g, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("w").alias("w")))
        if not current.limit(1).count():
            break
    return out


def tables(memberships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """communities (graph_name, level, id) and parents (graph_name, child_id, child_level, parent_id, parent_level)."""
    m = memberships
    up = m.select("graph_name", "entity_id", (F.col("level") - 1).alias("level"), F.col("community_id").alias("parent_id"))
    parents = m.join(up, ["graph_name", "entity_id", "level"]).select("graph_name", F.col("community_id").alias("child_id"), F.col("level").alias("child_level"), "parent_id", (F.col("level") + 1).alias("parent_level")).distinct()
    return m.select("graph_name", "level", F.col("community_id").alias("id")).distinct(), parents


def normal_path(path, last):
    """A path of community ids (a column), its final id appended, equal neighbours collapsed."""
    full = F.concat(path, F.array(last))
    return F.aggregate(full, F.slice(full, 1, 0), lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == x), acc).otherwise(F.concat(acc, F.array(x))))


def level_of(communities: DataFrame, selector: int | str | None) -> int | None:
    """The level that a selector names: None and all give None, finest 0, coarsest the greatest, numbers themselves."""
    if selector is None or selector == "all":
        return None
    if selector == "finest":
        return 0
    if selector == "coarsest":
        return communities.agg(F.max("level")).first()[0]
    if isinstance(selector, int) and not isinstance(selector, bool) and selector >= 0:
        return selector
    raise ValueError("a level is a number from 0 on, None, all, finest or coarsest")
