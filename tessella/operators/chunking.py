"""Chunking of documents. Every function maps a table of documents to a table of chunks without a shuffle but for page
windows over rows, which gather the pages of each document.

Null and empty texts give no chunks; blank chunks are dropped but keep their index.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import CHARS_PER_TOKEN, is_blank


class TokenCounter(Protocol):
    """Counts tokens and cuts texts after a number of them; has to be picklable."""

    def count(self, text: str) -> int: ...

    def truncate(self, text: str, max_tokens: int) -> str: ...


class TiktokenCounter:
    """Exact tokens of an encoding or model that tiktoken knows; it is loaded by the worker that first needs it."""

    def __init__(self, name: str = "cl100k_base"):
        self.name, self._own = name, None

    def __getstate__(self) -> dict:
        return {"name": self.name, "_own": None}

    def _encoding(self):
        if self._own is None:
            try:
                import tiktoken
            except ImportError as e:
                raise ImportError("tiktoken isn't installed") from e
            self._own = tiktoken.get_encoding(self.name) if self.name in tiktoken.list_encoding_names() else tiktoken.encoding_for_model(self.name)
        return self._own

    def count(self, text: str) -> int:
        return len(self._encoding().encode(text, disallowed_special=()))

    def truncate(self, text: str, max_tokens: int) -> str:
        own = self._encoding()
        return own.decode(own.encode(text, disallowed_special=())[: max(0, max_tokens)])


def _check(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("the size has to be positive, the overlap 0 at least and smaller than the size")


def _spans(text: Column, size: int, step: int) -> Column:
    """Starts of the chunks: multiples of step up to the first chunk that reaches the end."""
    n = F.length(text)
    last = F.ceil(F.greatest(F.lit(0), n - size) / step).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), last))


def _cut(docs: DataFrame, size: int, overlap: int, id: str, text: str) -> DataFrame:
    step = size - overlap
    rows = docs.withColumn("_i", F.explode(_spans(F.col(text), size, step)))
    start = F.col("_i") * step
    return rows.withColumns({"_start": start, "_text": F.substring(F.col(text), start + 1, F.lit(size))}).select(
        *[c for c in docs.columns if c != text],
        F.concat(F.col(id), F.lit(":chunk:"), F.col("_i")).alias("chunk_id"),
        F.col("_i").alias("index"),
        F.col("_text").alias("text"),
        F.col("_start").alias("char_start"),
        (F.col("_start") + F.length("_text")).alias("char_end"),
    )


def chunk_chars(docs: DataFrame, size: int = 1000, overlap: int = 200, id: str = "document_id", text: str = "text") -> DataFrame:
    """chunk_id, index, text, char_start, char_end and the documents' other columns."""
    _check(size, overlap)
    return _cut(docs, size, overlap, id, text).filter(~is_blank(F.col("text")))


def chunk_tokens(docs: DataFrame, size: int = 1000, overlap: int = 200, ratio: float = CHARS_PER_TOKEN, id: str = "document_id", text: str = "text") -> DataFrame:
    """Chunks of approximate tokens, with token_start and token_end; a document ends at its first blank chunk.

    Characters and tokens are in proportion, so the spans are in closed form. Which chunk is the first blank one is
    told from the text itself, so that nothing is shuffled.
    """
    _check(size, overlap)
    width, step = int(size * ratio), int((size - overlap) * ratio)
    if step <= 0:
        raise ValueError("a step has to have a character at least")
    x = F.col(text)
    starts = _spans(x, width, step)
    blank = F.filter(starts, lambda i: is_blank(F.substring(x, i * step + 1, F.lit(width))))
    upto = F.coalesce(F.element_at(F.when(F.size(blank) > 0, blank), 1), F.lit(2**31 - 1))
    rows = docs.withColumn("_i", F.explode(F.filter(starts, lambda i: i < upto)))
    piece = F.substring(x, F.col("_i") * step + 1, F.lit(width))
    rows = rows.withColumn("_text", piece)
    tokens = F.ceil(F.length("_text") / F.lit(float(ratio))).cast("int")
    return rows.select(
        *[c for c in docs.columns if c != text],
        F.concat(F.col(id), F.lit(":chunk:"), F.col("_i")).alias("chunk_id"),
        F.col("_i").alias("index"),
        F.col("_text").alias("text"),
        (F.col("_i") * step).alias("char_start"),
        (F.col("_i") * step + F.length("_text")).alias("char_end"),
        (F.col("_i") * (size - overlap)).alias("token_start"),
        (F.col("_i") * (size - overlap) + tokens).alias("token_end"),
    )


def chunk_exact(docs: DataFrame, counter: TokenCounter, size: int = 1000, overlap: int = 200, id: str = "document_id", text: str = "text") -> DataFrame:
    """Chunks by a tokenizer of the caller's, in Arrow batches: document id, chunk_id, index, text and spans."""
    _check(size, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, rest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index = at = token = 0
                while rest:
                    piece = counter.truncate(rest, size)
                    if not piece.strip():
                        break
                    out.append((doc, f"{doc}:chunk:{index}", index, piece, at, at + len(piece), token, token + counter.count(piece)))
                    if len(piece) >= len(rest):
                        break
                    skip = max(1, len(counter.truncate(rest, size - overlap)))
                    rest, at, token, index = rest[skip:], at + skip, token + size - overlap, index + 1
            if out:
                types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                names = [id, "chunk_id", "index", "text", "char_start", "char_end", "token_start", "token_end"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    schema = f"`{id}` string, chunk_id string, index int, text string, char_start int, char_end int, token_start int, token_end int"
    return docs.select(F.col(id).cast("string"), text).mapInArrow(run, schema)


def page_windows(pages: DataFrame, size: int = 2, step: int = 1, id: str = "document_id", order: str = "page", text: str = "text", record: str | None = None, collection: str | None = None, source: str | None = None) -> DataFrame:
    """Windows over the pages of each document, one row a page: chunk_id, index, page_start, page_end (from 1), text, and
    the pages' record ids, source ids (the record's where there is none) and distinct collections in order."""
    nothing = F.lit(None).cast("string")
    named = lambda c: F.col(c).cast("string") if c else nothing
    page = F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"), named(record).alias("r"), F.coalesce(named(source), named(record)).alias("s"), named(collection).alias("c"))
    return _windows(pages.groupBy(F.col(id).alias(id)).agg(F.array_sort(F.collect_list(page)).alias("_p")), size, step, id, [])


def envelope_windows(docs: DataFrame, size: int = 2, step: int = 1, id: str = "document_id", pages: str = "pages") -> DataFrame:
    """The same over an array of pages (structs of text and metadata) in each row, which keeps its other columns."""
    own = lambda p, k: F.try_element_at(p["metadata"], F.lit(k))
    some = lambda x: F.when(x != "", x)
    page = lambda p: F.struct(p["text"].alias("t"), own(p, "record_id").alias("r"), F.coalesce(some(own(p, "source")), some(own(p, "record_id")), own(p, "id")).alias("s"), own(p, "collection").alias("c"))
    rest = [c for c in docs.columns if c not in (id, pages, "text")]
    return _windows(docs.filter(F.col(pages).isNotNull()).select(id, *rest, F.transform(pages, page).alias("_p")), size, step, id, rest)


def _windows(docs: DataFrame, size: int, step: int, id: str, rest: list[str]) -> DataFrame:
    if size <= 0 or step <= 0:
        raise ValueError("size and step have to be positive")
    n = F.size("_p")
    last = F.ceil(F.greatest(F.lit(0), n - size) / step).cast("int")
    rows = docs.withColumn("_i", F.explode(F.sequence(F.lit(0), last))).withColumn("_w", F.slice("_p", F.col("_i") * step + 1, F.lit(size)))
    a, b = F.col("_i") * step + 1, F.col("_i") * step + F.size("_w")
    some = lambda f: F.filter(F.transform("_w", lambda x: x[f]), lambda x: x.isNotNull())
    return rows.select(
        id, *rest,
        F.concat(F.col(id).cast("string"), F.lit(":pages:"), a, F.lit("-"), b).alias("chunk_id"),
        F.col("_i").alias("index"),
        a.alias("page_start"),
        b.alias("page_end"),
        F.array_join(F.transform("_w", lambda x: x["t"]), "\n\n").alias("text"),
        some("r").alias("record_ids"),
        some("s").alias("source_ids"),
        F.array_distinct(some("c")).alias("collections"),
    ).filter(~is_blank(F.col("text")))


def with_metadata(chunks: DataFrame, document: str = "metadata") -> DataFrame:
    """chunks whose metadata is the document's with the chunk's spans, pages, records, sources and collections laid over it."""
    have = set(chunks.columns)
    own = F.create_map().cast("map<string,string>")
    for c in ("char_start", "char_end", "token_start", "token_end", "page_start", "page_end"):
        if c in have:
            own = F.map_concat(own, F.when(F.col(c).isNotNull(), F.create_map(F.lit(c), F.col(c).cast("string"))).otherwise(F.create_map().cast("map<string,string>")))
    for c in ("record_ids", "source_ids", "collections"):
        if c in have:
            own = F.map_concat(own, F.when(F.size(c) > 0, F.create_map(F.lit(c), F.to_json(c))).otherwise(F.create_map().cast("map<string,string>")))
    said = F.coalesce(F.col(document), F.create_map().cast("map<string,string>")) if document in have else F.create_map().cast("map<string,string>")
    x = chunks.withColumn("_own", own)
    return x.withColumn("metadata", F.map_concat(F.map_filter(said, lambda k, v: ~F.array_contains(F.map_keys("_own"), k)), "_own")).drop("_own")
