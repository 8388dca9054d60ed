"""Benchmark decontamination: seeds that no alignment of the threshold can avoid, then Smith-Waterman alignment.

A window of a text is aligned with an item, locally and word by word: match +2, other word -1, gap -1. The score is the
alignment's over that of an exact copy. All pairs that reach the threshold are found, with their exact best score:

Seeds are some words and some pairs of neighbouring words of the item. An alignment of m words' item that reaches the
threshold t, with M matches in R runs, loses R - 1 at least, so 2 * M - (R - 1) >= 2 * t * m. Let k = M - R be its matched
neighbours: it misses at most m * (1 - 2 * t) + k + 1 words. So either it holds one of any c words, or its k is
c - m * (1 - 2 * t) - 1 at least, and all pairs but one fewer than that are enough as seeds. Pass 1 counts words and pairs
over all documents; of each item the rarest words and pairs are taken, with the c that makes hits fewest. Counts decide
only what the search costs.
Pass 2 finds seeds in the training texts. Such an alignment spans m * (3 - 2 * t) words of text at most, so that it lies
within one of the tiles, twice as long and overlapping by half, about its seed. Tiles that hold too few of the item's
words for the threshold are left out (told by buckets of words, which never leaves out more), the others are aligned.

Both passes are maps over the scan with the items broadcast; no text is shuffled. Items are taken in parts of
ITEM_CHARS characters, so what is broadcast is bounded however many there are.

Items of fewer than SHORT words, which prose resembles by chance, count only as a whole: their threshold is 1.

Defined cases: null and empty texts hold nothing, and items without a word are in nothing; repeated items (same id and text)
count once; repeated documents give repeated rows; of equal alignments of a pair the one that ends first counts, then the one
found in the earlier tile; a very long text is read whole, a block at a time; null ids stay null; without items or documents
the result is empty. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import col, lean, ship, tidy
from tessella.llm.words import Lookup, blocks, portions, words

THRESHOLD = 0.5
#: Items of fewer words are found only where a text has all of their words in a row.
SHORT = 8
ITEM_CHARS = 8_000_000
MATCH, OTHER, GAP = 2, -1, -1
#: Cells of a row of alignments that are worked on at once.
CELLS = 1 << 18
#: Buckets of words of a tile, as bits of their hash; tiles, and hits of seeds, that are worked on at once.
BUCKET_BITS, TILES, HITS = 12, 1 << 10, 1 << 20

FOUND = "doc_id bigint, item_id bigint, score double, start_char bigint, end_char bigint"


def local_align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each item with its window: score, and the last word of it in item and window."""
    n = len(items)
    score, at_item, at_window = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort([len(w) for w in windows], kind="stable")
    a = 0
    while a < n:
        b, width = a, 0
        while b < n and (b == a or (b - a + 1) * max(width, len(windows[order[b]])) <= CELLS):
            width = max(width, len(windows[order[b]]))
            b += 1
        rows = order[a:b]
        tall = max(len(items[r]) for r in rows)
        # Fillers differ, so they never match.
        win = np.zeros((b - a, width), np.uint64)
        it = np.ones((b - a, tall), np.uint64)
        for k, r in enumerate(rows):
            win[k, : len(windows[r])] = windows[r]
            it[k, : len(items[r])] = items[r]
        h = np.zeros((b - a, width + 1), np.int32)
        slope = np.arange(width + 1, dtype=np.int32) * -GAP
        best, bi, bj = np.zeros(b - a, np.int32), np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
        for i in range(tall):
            new = np.zeros_like(h)
            np.add(h[:, :-1], np.where(win == it[:, i : i + 1], MATCH, OTHER).astype(np.int32), out=new[:, 1:])
            np.maximum(new, h + GAP, out=new)
            np.maximum(new, 0, out=new)
            # Gaps along the row: a running maximum of the cells, each lowered by its way.
            h = np.maximum.accumulate(new + slope, axis=1) - slope
            j = h.argmax(axis=1)
            top = h[np.arange(b - a), j]
            better = top > best
            best[better], bi[better], bj[better] = top[better], i, j[better] - 1
        score[rows], at_item[rows], at_window[rows] = best, bi, bj
        a = b
    return score, at_item, at_window


def _ragged(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places first[k] .. first[k] + many[k] - 1 of all k, and the k of each."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum()), np.repeat(np.arange(len(many)), many)


class Index:
    """Which items have a seed."""

    def __init__(self, gram: np.ndarray, item: np.ndarray):
        order = np.lexsort((item, gram))
        gram, item = gram[order], item[order]
        new = np.ones(len(gram), np.bool_)
        new[1:] = (gram[1:] != gram[:-1]) | (item[1:] != item[:-1])
        gram, self.item = gram[new], item[new]
        self.look = Lookup(gram)
        self.first = np.append(np.searchsorted(gram, self.look.keys), len(gram))

    def find(self, grams: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, place in the text, item) of the hits, HITS at once, about."""
        at, key = self.look.find(grams)
        many = self.first[key + 1] - self.first[key]
        upto = np.cumsum(many)
        s = 0
        while s < len(at):
            e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + HITS, side="right")))
            where, k = _ragged(self.first[key[s:e]], many[s:e])
            place = at[s:e][k]
            text = np.searchsorted(first, place, side="right") - 1
            yield text, place - first[text], self.item[where]
            s = e


def asked(size: np.ndarray | int, threshold: float) -> np.ndarray:
    """The threshold of items of so many words."""
    return np.where(np.asarray(size) < SHORT, 1.0, threshold)


class Items:
    """Test items by their words, and the indexes of their seeds: (item, gram) of words and of pairs."""

    def __init__(self, ids: list, hashes: list[np.ndarray], seeds: list[tuple[np.ndarray, np.ndarray]], threshold: float = THRESHOLD):
        self.ids, self.hashes = ids, hashes
        self.index = [Index(gram, item) for item, gram in seeds]
        self.size = np.fromiter((len(h) for h in hashes), np.int64, len(hashes))
        self.threshold = asked(self.size, threshold)
        self.span = np.maximum(1, np.floor(self.size * (3 - 2 * self.threshold) + 1e-9).astype(np.int64))
        self.first = np.cumsum(self.size) - self.size
        self.bucket = (np.concatenate(hashes or [np.zeros(0, np.uint64)]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    def _tiles(self, w) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Text, item, first word and end of the tiles that may hold an alignment of the threshold."""
        bucket = (w.hash >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        many = np.diff(w.first)
        for index, (grams, first) in zip(self.index, ((w.hash, w.first), w.grams(2)), strict=True):
            for text, place, item in index.find(grams, first):
                tile = place // self.span[item]
                most = int(tile.max()) + 1
                key = np.unique((text * len(self.ids) + item) * most + tile)
                key = np.unique(np.concatenate([key, (key - 1)[key % most > 0]]))
                tile, item, text = key % most, key // most % len(self.ids), key // most // len(self.ids)
                lo = tile * self.span[item]
                hi = np.minimum(lo + 2 * self.span[item], many[text])
                lo, hi = w.first[text] + lo, w.first[text] + hi
                for s in range(0, len(key), TILES):
                    part = slice(s, s + TILES)
                    n = len(item[part])
                    seen = np.zeros(n << BUCKET_BITS, np.bool_)
                    at, row = _ragged(lo[part], (hi - lo)[part])
                    seen[(row << BUCKET_BITS) + bucket[at]] = True
                    at, row = _ragged(self.first[item[part]], self.size[item[part]])
                    held = np.bincount(row[seen[(row << BUCKET_BITS) + self.bucket[at]]], minlength=n)
                    ok = held >= self.threshold[item[part]] * self.size[item[part]] - 1e-9
                    if ok.any():
                        yield text[part][ok], item[part][ok], lo[part][ok], hi[part][ok]

    def find(self, texts: list[str | None] | pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score, start and end character in the lower-case text) of each text with an alignment of the threshold or more."""
        for a, own in ((at + a, own[a:b]) for at, own in portions(texts) for a, b in blocks(own)):
            w = words(own)
            best: dict[tuple[int, int], tuple] = {}
            for text, item, lo, hi in self._tiles(w):
                score, ei, ew = local_align([self.hashes[i] for i in item], [w.hash[x:y] for x, y in zip(lo, hi, strict=True)])
                share = score / (MATCH * self.size[item])
                for c in np.flatnonzero(share >= self.threshold[item]):
                    k, i, x = int(text[c]), int(item[c]), int(lo[c])
                    new = (float(share[c]), -(x + int(ew[c])), x, int(ei[c]))
                    best[k, i] = max(new, best.get((k, i), new))
            for (k, i), (share, end, x, last_i) in best.items():
                last = -end
                back = local_align([self.hashes[i][: last_i + 1][::-1]], [w.hash[x : last + 1][::-1]])
                yield a + k, i, share, int(w.start[last - int(back[2][0])]), int(w.end[last])


def _counts(looks: list[Lookup]):
    """How often all documents hold each word and pair; pairs are numbered after the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(look.keys), np.int64) for look in looks]
        for batch in batches:
            for own in (own[a:b] for _, own in portions(batch.column(0)) for a, b in blocks(own)):
                w = words(own)
                for t, look, grams in zip(total, looks, (w.hash, w.grams(2)[0]), strict=True):
                    t += np.bincount(look.find(grams)[1], minlength=len(t))
        both = np.concatenate(total)
        k = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(both[k])], ["gram", "n"])

    return lean(run)


def choose(words_n: np.ndarray, pairs_n: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words and of the pairs of an item that are its seeds, by how often documents hold them."""
    m = len(words_n)
    word, pair = np.argsort(words_n, kind="stable"), np.argsort(pairs_n, kind="stable")
    cost_w, cost_p = np.concatenate([[0], np.cumsum(words_n[word])]), np.concatenate([[0], np.cumsum(pairs_n[pair])])
    spare = m * (1 - 2 * threshold) + 1
    c = np.arange(max(0, int(np.floor(spare + 1e-9)) + 1), m)
    p = len(pair) - np.maximum(0, np.ceil(c - spare - 1e-9).astype(np.int64) - 1)
    # All the words need no pairs.
    c, p = np.append(c, m), np.append(np.maximum(0, p), 0)
    k = int(np.argmin(cost_w[c] + cost_p[p]))
    return word[: c[k]], pair[: p[k]]


def _parts(items: DataFrame) -> Iterator[tuple[list, list[np.ndarray], list[np.ndarray]]]:
    """The items, ITEM_CHARS characters at a time, about: ids, words, n-grams."""
    items = items.select(col("item_id").cast("bigint").alias("item_id"), col("text").alias("text")).filter("text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-size // ITEM_CHARS)
    for p in range(parts):
        rows = items.filter(F.expr(f"pmod(xxhash64(text), {parts}) = {p}")).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        w = words([r.text for r in rows])
        yield [r.item_id for r in rows], np.split(w.hash, w.first[1:-1]) if rows else [], w


def seeds(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> Iterator[Items]:
    """The items of each part with their seeds, chosen by counts over all documents."""
    spark = docs.sparkSession
    ship(spark)
    for ids, hashes, w in _parts(items):
        g, first = w.grams(2)
        keep = [k for k in range(len(ids)) if len(hashes[k])]
        if not keep:
            continue
        ids, hashes, pairs = [ids[k] for k in keep], [hashes[k] for k in keep], [g[first[k] : first[k + 1]] for k in keep]
        looks = [Lookup(np.concatenate(hashes)), Lookup(np.concatenate(pairs))]
        found = docs.select(col("text")).filter("text is not null").mapInArrow(_counts(looks), "gram bigint, n bigint")
        count = np.zeros(len(looks[0].keys) + len(looks[1].keys), np.int64)
        for r in found.groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
            count[r.gram] = r.n
        n_w, n_p = count[: len(looks[0].keys)], count[len(looks[0].keys) :]
        chosen = [([], []), ([], [])]
        for k, (h, p) in enumerate(zip(hashes, pairs, strict=True)):
            places = choose(n_w[np.searchsorted(looks[0].keys, h)], n_p[np.searchsorted(looks[1].keys, p)], float(asked(len(h), threshold)))
            for (item, gram), own, at in zip(chosen, (h, p), places, strict=True):
                item.append(np.full(len(at), k))
                gram.append(own[at])
        yield Items(ids, hashes, [(np.concatenate(item), np.concatenate(gram)) for item, gram in chosen], threshold)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, item_id, score, start_char, end_char): the best alignment of each pair that reaches the threshold.

    Characters count in the lower-case text.
    """
    spark = docs.sparkSession
    out = None
    for part in seeds(docs, items, threshold):
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            own = shared.value
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), defaultdict(list)
                for k, i, score, s, e in own.find(batch.column(1)):
                    for name, v in zip(("doc_id", "item_id", "score", "start_char", "end_char"), (ids[k], own.ids[i], score, s, e), strict=True):
                        rows[name].append(v)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[c], pa.float64() if c == "score" else pa.int64()) for c in rows], list(rows))

        found = docs.select(col("doc_id").cast("bigint").alias("doc_id"), col("text").alias("text")).mapInArrow(lean(run), FOUND)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def _flag(shared) -> Column:
    @F.arrow_udf("boolean")
    def dirty(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            tidy(0.5)
            hit = np.zeros(len(t), np.bool_)
            for found in shared.value.find(t):
                hit[found[0]] = True
            yield pa.array(hit)

    return dirty


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that hold an item, by the same rule; null and empty texts stay."""
    text = col("text")
    out = docs
    for part in seeds(docs, items, threshold):
        out = out.filter(~_flag(docs.sparkSession.sparkContext.broadcast(part))(text))
    return out
