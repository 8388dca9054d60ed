r"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a text's language are multiplied:

* the text: a naive Bayes likelihood of its letter trigrams, hashed into BINS. Its tables are counted on labelled rows;
* the language its markup declares (the lang attribute of an html tag), with the reliability that declarations show;
* the suffix of its address (the host's last label), likewise;
* the prior of its host, smoothed towards that of the host's domain, which is smoothed towards that of all texts. A
  text's own count is taken out of it.

Reliabilities and priors are grouped aggregations over the decisions that the text alone gives with CONFIDENT
posterior or more, over all texts. The text is read once for that; what is kept of it is a row of log-likelihoods.
A further class, `und`, in which all trigrams are alike, stands for every language that has no labels.

A text is accepted if one language's posterior is ACCEPT or more.

Defined cases: a null or empty text, or one without letters, is `und` and not accepted, with probability 0; texts of
any length count whole; without labelled rows everything is `und`; null or empty addresses give no evidence beyond the
prior of all texts; null ids stay null; equal rows get equal decisions, repeated rows stay; of languages that tie the first by
name counts, `und` last; an empty table gives an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import col, cut, fresh, lean, ship
from tessella.llm.words import BLOCK_CHARS, blocks, portions

#: The text model is counted on about so many labelled rows, shared out evenly: of a rare language all rows count.
SAMPLE_ROWS = 20_000
BINS = 1 << 16
ALPHA = 0.1
#: Trigrams overlap, so that each counts a third.
TEMPER = 1 / 3
CONFIDENT, ACCEPT = 0.9, 0.5
#: How many texts the prior of the level above is worth.
WEIGHT = 10.0
UND = "und"
#: Rejections are broadcast up to this many; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000


@cache
def _letters() -> np.ndarray:
    of = np.zeros(0x110000, np.bool_)
    of[:0x3FFFF] = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x3FFFF)), np.bool_, 0x3FFFF)
    return of


def _bins(low: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the letters in a lower-case text that begins and ends with a blank, and the bins of the trigrams around them."""
    cp = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    c = np.where(letter, cp, np.uint32(32))
    at = np.flatnonzero(letter[1:-1]) + 1
    with np.errstate(over="ignore"):
        h = c[at - 1] * np.uint32(0x9E3779B1) + c[at] * np.uint32(0x85EBCA6B) + c[at + 1] * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    return at, h >> np.uint32(16)


def trigrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(texts' numbers, bins) of all trigrams, in turns of bounded size."""
    for a, b in blocks(texts):
        own = [(t or "").lower() for t in texts[a:b]]
        if len(own) == 1 and len(own[0]) > BLOCK_CHARS:
            t = " " + own[0] + " "
            for x in range(1, len(t) - 1, BLOCK_CHARS):
                at, h = _bins(t[x - 1 : x + BLOCK_CHARS + 1])
                yield np.full(len(at), a), h
            continue
        start = np.cumsum([0] + [len(t) + 1 for t in own])
        at, h = _bins(" " + " ".join(own) + " ")
        yield a + np.searchsorted(start, at - 1, side="right") - 1, h


class TextModel:
    """Log-probability of each bin under each language; the last is `und`."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UND]
        p = (counts + ALPHA) / (counts.sum(axis=1, keepdims=True) + ALPHA * BINS)
        self.table = np.log(np.vstack([p, np.full((1, BINS), 1 / BINS)])).T.astype(np.float32).copy()

    def score(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (texts x languages) and numbers of letters."""
        out, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for first, own in portions(texts):
            for text, h in trigrams(own):
                if len(h):
                    begin = np.flatnonzero(np.diff(text, prepend=-1))
                    out[first + text[begin]] += np.add.reduceat(self.table[h], begin, axis=0, dtype=np.float64)
                    letters[first : first + len(own)] += np.bincount(text, minlength=len(own))
        return out * TEMPER, letters


def train(docs: DataFrame, label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """The text model of about sample_rows labelled rows, chosen by hash, as many of each language where it has them."""
    ship(docs.sparkSession)
    rows = docs.select(F.lower(F.trim(col(label).cast("string"))).alias("label"), col("text").cast("string").alias("text")).filter("label != '' and text != ''")
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if sum(counts.values()) > sample_rows:
        share, left, n = F.lit(0), sample_rows, len(counts)
        for name in sorted(counts, key=lambda x: (counts[x], x)):
            take = min(1.0, max(1, left // n) / counts[name])
            left, n = left - int(take * counts[name]), n - 1
            share = F.when(F.col("label") == name, int(take * (1 << 31))).otherwise(share)
        rows = rows.filter(F.pmod(F.xxhash64("text", "label"), F.lit(1 << 31)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, texts in portions(batch.column(1)):
                own = names[first : first + len(texts)]
                for name in set(own):
                    total = by.setdefault(name, np.zeros(BINS, np.int64))
                    for _, h in trigrams([t for t, x in zip(texts, own, strict=True) if x == name]):
                        total += np.bincount(h, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array([x.tobytes() for x in by.values()], pa.binary())], ["label", "counts"])

    found: dict[str, np.ndarray] = {}
    for r in rows.repartition(8).mapInArrow(lean(count), "label string, counts binary").collect():
        found[r.label] = found.get(r.label, 0) + np.frombuffer(r.counts, np.int64)
    names = sorted(x for x in found if x != UND)
    return TextModel(names, np.array([found[x] for x in names]).reshape(-1, BINS))


def _host(address: Column) -> Column:
    a = F.lower(F.trim(F.coalesce(address.cast("string"), F.lit(""))))
    return F.regexp_extract(a, r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)", 1)


def _declared(markup: Column, languages: list[str]) -> Column:
    """The primary subtag that an html tag declares, `other` for one without a model, null for none."""
    tag = F.lower(F.regexp_extract(markup.cast("string"), r"""(?i)<html\b[^>]{0,2000}?\blang\s*=\s*["']?([a-zA-Z]{2,8})""", 1))
    return F.when(tag == "", None).when(tag.isin(languages[:-1]), tag).otherwise(F.when(tag.isNotNull(), "other"))


def _scored(docs: DataFrame, model: TextModel, id: str, text: str, address: str | None, markup: str | None) -> DataFrame:
    """A row for each document: id, hash of text and address, host, declared language, log-likelihoods."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ll, letters = shared.value.score(batch.column(4))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(letters), *(pa.array(ll[:, i]) for i in range(k))], ["id", "key", "host", "declared", "letters", *(f"ll_{i}" for i in range(k))])

    rows = docs.select(
        col(id).cast("bigint").alias("id"),
        _key(text, address).alias("key"),
        (_host(col(address)) if address else F.lit("")).alias("host"),
        (_declared(col(markup), model.languages) if markup else F.lit(None).cast("string")).alias("declared"),
        col(text).cast("string").alias("text"),
    )
    return cut(rows.mapInArrow(lean(run), "id bigint, key bigint, host string, declared string, letters bigint, " + ", ".join(f"ll_{i} double" for i in range(k))))


def _key(text: str, address: str | None) -> Column:
    some = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    return F.xxhash64(some(text), *([some(address)] if address else []))


def _normal(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    e = [F.exp(s - top) for s in scores]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def identify(
    docs: DataFrame, model: TextModel, id: str = "doc_id", text: str = "text", address: str | None = "source", markup: str | None = "text"
) -> DataFrame:
    """(id, language, probability, accepted) of each row."""
    return _decided(docs, model, id, text, address, markup).select(F.col("id").alias(id), "language", "probability", "accepted")


def _decided(docs: DataFrame, model: TextModel, id: str, text: str, address: str | None, markup: str | None) -> DataFrame:
    ship(docs.sparkSession)
    k = len(model.languages)
    each = range(k)
    rows = _scored(docs, model, id, text, address, markup)
    rows = rows.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.when(F.col("host").rlike(r"\.[a-z]{2,24}$"), F.substring_index("host", ".", -1)))
    # What the text alone says, where it is sure.
    alone = _normal([F.col(f"ll_{i}") for i in each])
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-i).alias("i")) for i, p in enumerate(alone)]))
    rows = rows.withColumn("best", best).withColumn("own", F.when((F.col("letters") > 0) & (F.col("best.p") >= CONFIDENT), -F.col("best.i")))
    rows = rows.drop("best")
    counts = [F.count_if(F.col("own") == i).cast("double").alias(f"n_{i}") for i in each]
    sums = lambda to: [F.sum(f"n_{i}").alias(f"{to}_{i}") for i in each]
    hosts = cut(rows.filter("host != ''").groupBy("host", "domain", "suffix").agg(*counts))
    domains = hosts.groupBy("domain").agg(*sums("d"))
    total = rows.agg(*counts).first() or [0.0] * k
    total = [float(x or 0) for x in total]
    everyone = [(x + 1) / (sum(total) + k) for x in total]
    suffixes = hosts.filter("suffix is not null").groupBy("suffix").agg(*sums("s"))
    declared = rows.filter("declared is not null").groupBy("declared").agg(*[F.count_if(F.col("own") == i).cast("double").alias(f"m_{i}") for i in each])
    n_suffixes, n_declared = suffixes.count(), k + 1
    of_suffix = [float(x or 0) for x in suffixes.agg(*[F.sum(f"s_{i}") for i in each]).first()]
    of_declared = [float(x or 0) for x in declared.agg(*[F.sum(f"m_{i}") for i in each]).first()]

    rows = rows.join(hosts.select("host", *[f"n_{i}" for i in each]), "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left").join(declared, "declared", "left")
    mine = [F.when(F.col("own") == i, 1.0).otherwise(0.0) for i in each]
    at = lambda c, i: F.greatest(F.lit(0.0), F.coalesce(F.col(f"{c}_{i}"), F.lit(0.0)) - mine[i])
    d_total = sum((at("d", i) for i in each), F.lit(WEIGHT))
    n_total = sum((at("n", i) for i in each), F.lit(WEIGHT))
    scores = []
    for i in each:
        prior = (at("n", i) + WEIGHT * (at("d", i) + WEIGHT * everyone[i]) / d_total) / n_total
        by_suffix = F.when(F.col("suffix").isNotNull(), F.log((at("s", i) + 1) / (of_suffix[i] + n_suffixes - mine[i]))).otherwise(0.0)
        by_declared = F.when(F.col("declared").isNotNull(), F.log((at("m", i) + 1) / (of_declared[i] + n_declared - mine[i]))).otherwise(0.0)
        scores.append(F.col(f"ll_{i}") + F.log(prior) + by_suffix + by_declared)
    # Scores become columns of a written table: planned in one piece, each would be repeated in every expression over it.
    scored = cut(rows.select("id", "key", "letters", *[x.alias(f"s_{i}") for i, x in enumerate(scores)]))
    best = F.array_max(F.array(*[F.struct(F.col(f"s_{i}").alias("s"), F.lit(-i).alias("i")) for i in each]))
    some = F.col("letters") > 0
    top = scored.withColumn("top", best).withColumn("p", 1 / sum((F.exp(F.col(f"s_{i}") - F.col("top.s")) for i in each), F.lit(0.0)))
    names = F.array(*[F.lit(x) for x in model.languages])
    language = F.when(some, F.element_at(names, 1 - F.col("top.i"))).otherwise(UND)
    probability = F.when(some, F.col("p")).otherwise(0.0)
    return top.select("id", "key", language.alias("language"), probability.alias("probability"), (some & (F.col("top.i") > 1 - k) & (F.col("p") >= ACCEPT)).alias("accepted"))


def of_documents(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))


def of_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Pages (page_id, language, probability, accepted), by the text model of documents; what is scored is the html without
    its tags. A null or empty html, or one without letters outside of tags, is `und` and not accepted; null ids and addresses,
    repeated pages, empty tables, very long pages and other columns are as in the module's cases."""
    text = F.regexp_replace(col("html").cast("string"), r"(?is)<(script|style|nav)\b.*?</\1>|<[^>]*>", " ")
    (name,) = fresh(pages, "_text")
    return identify(pages.withColumn(name, text), train(docs), "page_id", name, "url", "html")


def keep(docs: DataFrame, model: TextModel | None = None) -> DataFrame:
    """The documents whose language is accepted, all columns as they are."""
    gone = _decided(docs, model or train(docs), "doc_id", "text", "source", "text").filter("not accepted").select("id", "key").distinct()
    gone = cut(gone)
    i, k = fresh(docs, "_id", "_key")
    gone = gone.toDF(i, k)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, col("doc_id").cast("bigint").eqNullSafe(F.col(i)) & (_key("text", "source") == F.col(k)), "left_anti")
