"""Assembly of extracted items into entities, relationships, evidence and claims.

Items carry their place (document_id, chunk_id, chunk_index, pos); where one of several counts, it is the first by place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import claim_id, entity_uuid, relationship_uuid
from tessella.sources.lineage import cut, ship

DESCRIPTION_CHARS = 2000
#: Pairs of terms that are made at once, that a bucket has, about, and that are given at once; buckets a term's pairs are spread over.
RUN_PAIRS, BUCKET_PAIRS, OUT_PAIRS, SPREAD = 1 << 22, 1 << 22, 1 << 19, 4


def _place() -> Column:
    return F.struct("document_id", "chunk_index", "pos")


def entities(nodes: DataFrame, graph: str) -> DataFrame:
    """One row a canonical key: the type, name and properties of its first occurrence, and its identifier."""
    key = F.coalesce(F.try_element_at("properties", F.lit("canonical_key")), F.col("node_id")) if "properties" in nodes.columns else F.col("node_id")
    carried = [c for c in ("label", "name", "properties") if c in nodes.columns]
    first = nodes.groupBy(key.alias("canonical_key")).agg(F.min_by(F.struct(*carried), _place()).alias("f"))
    out = first.select(F.lit(graph).alias("graph_name"), entity_uuid(F.lit(graph), F.col("canonical_key")).alias("id"), F.col("f.label").alias("type"), "canonical_key", F.coalesce("f.name", "canonical_key").alias("name"), *([F.col("f.properties").alias("properties")] if "properties" in carried else []))
    return out


def descriptions(items: DataFrame, keys: list[str], limit: int = DESCRIPTION_CHARS) -> DataFrame:
    """keys, description: the distinct descriptions of each key, by document, chunk (as text) and place, joined by `; `."""
    d = F.trim("description")
    once = items.filter(d != "").groupBy(*keys, d.alias("d")).agg(F.min(F.struct("document_id", "chunk_id", "pos")).alias("at"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]), "; ")
    all_of = once.groupBy(*keys).agg(joined.alias("a"))
    return all_of.select(*keys, F.when(F.length("a") > limit, F.concat(F.substring("a", 1, limit), F.lit("..."))).otherwise(F.col("a")).alias("description"))


def relationships(items: DataFrame, graph: str | None = None) -> DataFrame:
    """One row a (source_id, type, target_id): observation_count, weight (that count), source_chunk_ids in order, with
    repeats, and with a graph's name an identifier."""
    chunks = F.transform(F.array_sort(F.collect_list(F.struct(_place().alias("at"), "chunk_id"))), lambda x: x["chunk_id"])
    out = items.groupBy("source_id", "type", "target_id").agg(F.count("*").alias("observation_count"), F.count("*").cast("double").alias("weight"), chunks.alias("source_chunk_ids"))
    if graph is None:
        return out
    key = F.concat_ws(":", "source_id", "type", "target_id")
    return out.withColumns({"graph_name": F.lit(graph), "canonical_key": key, "id": relationship_uuid(F.lit(graph), key)})


def evidence(nodes: DataFrame) -> DataFrame:
    """chunk_id, node_id of each node's occurrences, once a chunk."""
    return nodes.select("chunk_id", "node_id").distinct()


def claims(items: DataFrame, graph: str) -> DataFrame:
    """Claim records of items (document_id, chunk_id, subject, claim_type, description, status)."""
    return items.select(
        F.lit(graph).alias("graph_name"),
        claim_id(F.col("document_id"), F.col("chunk_id"), F.col("subject"), F.col("claim_type"), F.col("description")).alias("id"),
        entity_uuid(F.lit(graph), F.col("subject")).alias("entity_id"),
        "chunk_id", "claim_type", "description", "status",
    )


def cooccurrence(tokens: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """Pairs of terms of a chunk as relationship items, of terms that between least and most chunks hold.

    tokens: document_id, chunk_id, chunk_index, term, once a chunk. A term in fewer chunks than `least` can't repeat.
    Without `most` no term is too frequent: pairs are made within a chunk, so that its length bounds them."""
    x = _terms(tokens, least, most)
    pairs = F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: b > a), lambda b: F.struct(a.alias("s"), b.alias("o")))))
    x = x.select("document_id", "chunk_id", "chunk_index", F.posexplode(pairs).alias("pos", "p"))
    return x.select("document_id", "chunk_id", "chunk_index", "pos", F.col("p.s").alias("source_id"), F.lit("RELATED_TO").alias("type"), F.col("p.o").alias("target_id"))


def _terms(tokens: DataFrame, least: int, most: int | None) -> DataFrame:
    """document_id, chunk_id, chunk_index, t: the terms of each chunk that between least and most chunks hold, sorted."""
    df = F.col("df")
    band = tokens.groupBy("term").agg(F.count("*").alias("df")).filter(df >= least if most is None else df.between(least, most))
    t = tokens.join(band, "term").select("document_id", "chunk_id", "chunk_index", "term")
    return t.groupBy("document_id", "chunk_id", "chunk_index").agg(F.array_sort(F.collect_list("term")).alias("t")).filter("size(t) > 1")


def related(tokens: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """relationships(cooccurrence(tokens, least, most)) without a row for each occurrence.

    Pairs are made in numpy for many chunks at once and shuffled by buckets, as compressed numbers into lists of the terms
    and chunks that they name. Most pairs occur once, so adding up before the shuffle wouldn't make them fewer."""
    spark = tokens.sparkSession
    ship(spark)
    terms = cut(_terms(tokens, least, most).select(F.col("document_id").cast("string").alias("document_id"), F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("chunk_id").cast("string").alias("chunk_id"), "t"))
    n = F.size("t").cast("bigint")
    total = terms.agg(F.sum(n * (n - 1))).first()[0] or 0
    found = terms.mapInArrow(_pairs(int(total // 2 // BUCKET_PAIRS) + 16), "bucket int, terms array<string>, documents array<string>, indexes array<bigint>, chunks array<string>, pairs binary")
    return found.groupBy("bucket").applyInArrow(_gathered, "source_id string, type string, target_id string, observation_count bigint, weight double, source_chunk_ids array<string>")


def _ranked(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the distinct ones, sorted by bytes, and these."""
    e = values.dictionary_encode()
    order = pc.sort_indices(e.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[e.indices.to_numpy()], e.dictionary.take(pa.array(order))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    x = column.combine_chunks()
    return x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks)


def _lists(values: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.concat_arrays(values) if values else pa.array([], kind))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed by planes of bytes."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return np.uint32(len(numbers)).tobytes() + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    planes = pa.decompress(raw[4:], 4 * n, "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def _pairs(buckets: int):
    """Of chunks and their terms: for each bucket of pairs the terms and chunks they name and, as numbers into these, their
    first terms, second terms and chunks."""

    def made(table: pa.Table) -> pa.RecordBatch:
        lists = _whole(table.column("t"))
        many = lists.value_lengths().to_numpy()
        code, names = _ranked(lists.flatten())
        row = np.repeat(np.arange(len(many)), many)
        at = np.arange(len(code))
        after = np.cumsum(many)[row] - at - 1
        first = np.repeat(at, after)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(after) - after, after)
        s, o, c = code[first], code[second], row[first].astype(np.int32)
        del first, second
        h = pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object))
        bucket = ((h[s] + (h[o] >> np.uint64(32)) % np.uint64(SPREAD)) % np.uint64(buckets)).astype(np.int64)
        key = (bucket * len(names) + s) * len(names) + o
        by = np.argsort(key, kind="stable")
        by = by[s[by] != o[by]]
        del key
        s, o, c, bucket = s[by], o[by], c[by], bucket[by]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        terms, chunks, blobs = [], [], []
        for a, b in zip(cuts, np.append(cuts, len(s))[1:], strict=True):
            named, x = np.unique(np.concatenate([s[a:b], o[a:b]]), return_inverse=True)
            of, y = np.unique(c[a:b], return_inverse=True)
            terms.append(names.take(pa.array(named)))
            chunks.append(of)
            blobs.append(_packed(np.concatenate([x, y])))
        of = [pa.array(x) for x in chunks]
        each = [_lists([_whole(table.column(k)).take(x) for x in of], t) for k, t in (("document_id", pa.string()), ("chunk_index", pa.int64()), ("chunk_id", pa.string()))]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), _lists(terms, pa.string()), *each, pa.array(blobs, pa.binary())], ["bucket", "terms", "documents", "indexes", "chunks", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("t")).value_lengths().to_numpy().astype(np.int64)
            upto, a = np.cumsum(n * (n - 1) // 2), 0
            while a < len(batch):
                before = upto[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(upto, before + RUN_PAIRS - many, side="right")))
                held.append(batch.slice(a, b - a))
                many += int(upto[b - 1] - before)
                a = b
                if many >= RUN_PAIRS or a < len(batch):
                    yield made(pa.Table.from_batches(held))
                    held, many = [], 0
        if held:
            yield made(pa.Table.from_batches(held))

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket: its relationships."""
    table = pa.Table.from_batches(batches)
    column = lambda k: _whole(table.column(k))
    term, names = _ranked(column("terms").flatten())
    document, _ = _ranked(column("documents").flatten())
    order = np.lexsort((column("indexes").flatten().to_numpy(zero_copy_only=False), document))
    chunks, place = column("chunks").flatten().take(pa.array(order)), np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    s, o, c, t0, c0 = [], [], [], 0, 0
    for raw, n_terms, n_chunks in zip(table.column("pairs"), column("terms").value_lengths().to_pylist(), column("chunks").value_lengths().to_pylist(), strict=True):
        x, y, z = _unpacked(raw.as_py()).reshape(3, -1)
        s.append(term[x + t0])
        o.append(term[y + t0])
        c.append(place[z + c0])
        t0, c0 = t0 + n_terms, c0 + n_chunks
    del table, term, place
    key, c = np.concatenate(s) * len(names) + np.concatenate(o), np.concatenate(c)
    del s, o
    by = np.argsort(c, kind="stable")
    by = by[np.argsort(key[by], kind="stable")]
    key, c = key[by], c[by]
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    end, a = np.append(begin[1:], len(key)), 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(end, begin[a] + OUT_PAIRS, side="right")))
        pair, n = key[begin[a:b]], end[a:b] - begin[a:b]
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), chunks.take(pa.array(c[begin[a] : end[b - 1]])))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(pair // len(names))), pa.array(["RELATED_TO"] * len(pair)), names.take(pa.array(pair % len(names))), pa.array(n), pa.array(n.astype(np.float64)), ids], ["source_id", "type", "target_id", "observation_count", "weight", "source_chunk_ids"])
        a = b
