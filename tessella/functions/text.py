"""Column functions over text: identifiers, hashes, tokens, names. All run in the JVM unless said otherwise."""

from __future__ import annotations

import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

CHARS_PER_TOKEN = 4.0
NAMESPACE = uuid.NAMESPACE_URL.hex
ID_PREFIX = "https://graph.invalid"
SUFFIXES = ("corp", "corporation", "inc", "incorporated", "ltd", "limited", "llc", "co", "company", "plc", "llp", "lp", "holdings", "group")


def token_count(text: Column, ratio: float = CHARS_PER_TOKEN) -> Column:
    """Approximate tokens: characters by ratio, rounded up; 0 for empty and null text."""
    return F.coalesce(F.ceil(F.length(text) / F.lit(float(ratio))), F.lit(0)).cast("int")


def truncate(text: Column, max_tokens: int, ratio: float = CHARS_PER_TOKEN) -> Column:
    """The prefix of text that has max_tokens approximate tokens."""
    if max_tokens < 0:
        raise ValueError("max_tokens can't be negative")
    return F.substring(text, 1, int(max_tokens * ratio))


def is_blank(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*$")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def document_id(text: Column, *names: Column) -> Column:
    """doc: and the slug of the first name that isn't empty, or else 16 digits of the text's hash."""
    by_name = [F.when(F.length(slug(n)) > 0, slug(n)) for n in names]
    return F.concat(F.lit("doc:"), F.coalesce(*by_name, F.substring(text_hash(text), 1, 16)))


def uuid5(name: Column) -> Column:
    """The name-based UUID of version 5 in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def entity_uuid(graph: Column, key: Column, prefix: str = ID_PREFIX) -> Column:
    return uuid5(F.concat(F.lit(f"{prefix}/entity/"), graph, F.lit("/"), key))


def relationship_uuid(graph: Column, key: Column, prefix: str = ID_PREFIX) -> Column:
    return uuid5(F.concat(F.lit(f"{prefix}/relationship/"), graph, F.lit("/"), key))


def claim_id(document: Column, chunk: Column, subject: Column, kind: Column, description: Column) -> Column:
    h = F.substring(F.sha2(F.concat_ws(":", subject, kind, description), 256), 1, 12)
    return F.concat_ws(":", F.lit("claim"), document, chunk, h)


def excerpt(text: Column, size: int = 200) -> Column:
    return F.substring(text, 1, size)


@F.arrow_udf(StringType())
def _fold(names: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFC", x).casefold() for x in names.to_pylist()], pa.string())


def normalize_name(name: Column, unicode: bool = False) -> Column:
    """A name without case, organisation suffixes, punctuation and spaces; null gives ''.

    With unicode, names are brought to NFC and case-folded, by an Arrow UDF; else lower case does, which is the same
    for ASCII.
    """
    x = _fold(name) if unicode else F.lower(name)
    x = F.regexp_replace(x, rf"(?iU)\b({'|'.join(SUFFIXES)})\.?\b", "")
    x = F.regexp_replace(x, r"(?U)[^\w\s]", "")
    return F.coalesce(F.regexp_replace(x, r"(?U)\s+", ""), F.lit(""))


def entity_text(label: Column, name: Column, description: Column) -> Column:
    """What is embedded of an entity."""
    d = F.coalesce(description, F.lit(""))
    return F.concat(label, F.lit(": "), F.coalesce(name, F.lit("")), F.when(d != "", F.concat(F.lit(" - "), d)).otherwise(""))


def flat_properties(properties: Column) -> Column:
    """A map as `key: value, ...`, by key."""
    each = F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"].cast("string"), F.lit(""))))
    return F.array_join(each, ", ")


def lexical_query(text: Column) -> Column:
    """Quoted phrases and words of a query, each quoted, joined by OR; a query without either is quoted whole."""
    phrases = F.transform(F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), lambda p: F.concat(F.lit('"'), p, F.lit('"')))
    words = F.transform(F.regexp_extract_all(F.regexp_replace(text, '"[^"]*"', " "), F.lit("([A-Za-z0-9_]+)"), F.lit(1)), lambda w: F.concat(F.lit('"'), w, F.lit('"')))
    terms = F.array_distinct(F.concat(phrases, words))
    whole = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit("")), F.lit('"'))
    return F.when(F.size(terms) > 0, F.array_join(terms, " OR ")).otherwise(whole)


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")


@F.arrow_udf(DoubleType())
def indel_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """indel_scores() of two columns; null counts as empty."""
    return pa.array(indel_scores(*([x or "" for x in y.to_pylist()] for y in (a, b))))


def indel_scores(left: list[str], right: list[str]) -> np.ndarray:
    """100 * 2 * LCS / (len a + len b) of pairs of strings, 100 for two empty ones; a dynamic programme over all of them at once."""
    out = np.empty(len(left))
    size = np.fromiter((max(len(x), len(y)) for x, y in zip(left, right, strict=True)), np.int64, len(left))
    order = np.argsort(size, kind="stable")
    for s in range(0, len(order), 2048):
        rows = order[s : s + 2048]
        wide = max([1, *(len(left[r]) for r in rows)]), max([1, *(len(right[r]) for r in rows)])
        grids = []
        for texts, n, filler in ((left, wide[0], 1 << 21), (right, wide[1], 1 << 22)):
            g = np.full((len(rows), n), filler, np.int64)
            for k, r in enumerate(rows):
                g[k, : len(texts[r])] = np.frombuffer(texts[r].encode("utf-32-le", "surrogatepass"), np.uint32)
            grids.append(g)
        row = np.zeros((len(rows), wide[1] + 1), np.int32)
        for i in range(wide[0]):
            hit = row[:, :-1] + (grids[1] == grids[0][:, i : i + 1])
            row = np.concatenate([row[:, :1], np.maximum.accumulate(np.maximum(hit, row[:, 1:]), axis=1)], axis=1)
        total = np.fromiter((len(left[r]) + len(right[r]) for r in rows), np.int64, len(rows))
        out[rows] = np.where(total == 0, 100.0, 200.0 * row[:, -1] / np.maximum(total, 1))
    return out
