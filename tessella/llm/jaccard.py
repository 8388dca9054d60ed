"""N-gram Jaccard join of documents, exact, and near-duplicate removal by it.

A document is the set of its word n-grams. Texts with equal sets form a class, and only classes are joined. The plan:

1. One pass gives each document's class and counts n-grams that repeat within large runs of documents; the sums tell
   the heavy n-grams. Any choice of those is right: it only sets the order of n-grams (others by hash, then the heavy
   ones by count). What is broadcast is at most HEAVY_LIMIT of them. The pass also gives each set some bands of least
   hashes; sets with an equal band are kin. Kinship is never an answer, it only says that two sets will meet in step 3
   anyhow; groups of copies so cost what they are, not their square, in step 2.
2. In that order each set sends its prefix to the lists of its n-grams, with their positions. Two sets of Jaccard t or
   more meet in one. Lists are cut into blocks of positions; of each block an entry meets the one run of sizes that size
   and position admit, and skips the rest, as it skips kin. A pair goes on if the n-grams it shares in lists and the rest
   beyond the prefixes could suffice. What passes joins the kin in connected components. Lists tell n-grams by 32 bits and
   positions by 8, rounded down; that can only add a pair.
3. The whole sets of a component meet in one task (an oversized one is cut into a grid of tasks), where an exact join
   skips by set relations (see setjoin): lists in position blocks, and answers derived from those of a similar set.

A cluster of edited copies that grows with the table has pairs as its square. They are made, sifted and counted in
portions, so that a task holds some of them at a time and never a bucket's or a component's.

Lists and sets move as numpy arrays in binary rows, sorted and counted in numpy; text is never shuffled.

links() gives a row for each document: the least id of the group that links connect it with, and the number of its
links, that is of other documents at the threshold or above. similar() gives the join itself, with equal sets not
multiplied out: each class of more than one document gives (first, other, 1.0) for its other documents, each pair of
classes (first, first, similarity). A class's first is its least id; expand() multiplies out. Group sizes so cost what
they are, not their square.

Defined cases: null and empty texts, and those without a letter or digit, have no set and match nothing; a text of
fewer than n words has one n-gram, of all of them; a very long text counts whole, its words are found a block at a
time; a repeated id with the same set counts once; an id with several sets has a row for each; rows without an id are
in no pair, row or count (removal still treats them as documents); ties go to the least id. An empty table gives an
empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import col, cut, fresh, lean, partitions, ship, tidy
from tessella.llm.graph import components, roots, rows_of
from tessella.llm.setjoin import few_join, jaccard_portions, least
from tessella.llm.words import Lookup, blocks, mix64, portions, words

N = 4
#: Of all pairs of sf0.1 at 0.3 and above, those with 0.7 of the words in common order are taken for edited copies: 0.44
#: finds 99 % of them and one pair of others, 0.5 finds 97 %; below 0.43 most pairs only share a passage.
THRESHOLD = 0.44
#: An n-gram counts as heavy from this count on, in runs of so many n-grams; so many of them are broadcast at most.
HEAVY, RUN, HEAVY_LIMIT = 32, 1 << 21, 1 << 21
#: N-grams of the sets that one task joins, about; where a component is cut, of each of the two sides that meet.
TASK_GRAMS = 1 << 20
#: Pairs of lists, and entries with the blocks they meet, that are made at once; blocks of positions of a list.
PAIRS, BLOCKS = 1 << 19, 16
#: Pairs that a bucket holds before it passes them on, and that are sifted at once.
HELD = 1 << 20
#: Bands of a set, and least hashes in each; kin that are broadcast at most, larger groups first.
BANDS, BAND, KIN_LIMIT = 4, 4, 1 << 22
#: Buckets of lists at least, and n-grams of all sets for each; documents whose lists are made up at once.
BUCKETS, BUCKET_GRAMS, SLICE = 64, 1 << 22, 4096
#: Up to this size a component's pairs are taken one by one.
FEW = 6
BLOOM_BITS = 26
_U = np.uint64


def sets(texts: list[str | None] | pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, sorted distinct n-gram hashes) of each text that has some."""
    for at, own in portions(texts):
        for a, b in blocks(own):
            g, first = words(own[a:b]).grams(n)
            for k in range(b - a):
                if first[k] < first[k + 1]:
                    s = np.sort(g[first[k] : first[k + 1]])
                    keep = np.ones(len(s), np.bool_)
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    yield at + a + k, s[keep]


def set_key(s: np.ndarray) -> int:
    """A hash of a set, as a signed 64-bit integer."""
    with np.errstate(over="ignore"):
        h = mix64(np.array([np.add.reduce(mix64(s + _U(0x51ED27)), dtype=_U) + _U(len(s)) * _U(0x9E3779B97F4A7C15)], _U))
    return int(h.view(np.int64)[0])


def bands(s: np.ndarray) -> list[int | None]:
    """Hashes of the bands of a sorted set: its n-grams are dealt into BANDS * BAND bins, of which each gives its least."""
    least_of = np.zeros(BANDS * BAND, _U)
    bins, at = np.unique(s % _U(BANDS * BAND), return_index=True)
    least_of[bins.astype(np.int64)] = s[at]
    with np.errstate(over="ignore"):
        h = mix64(least_of + np.arange(1, BANDS * BAND + 1, dtype=_U)).reshape(BANDS, BAND)
        h = mix64(h.sum(axis=1, dtype=_U)).view(np.int64)
    full = least_of.reshape(BANDS, BAND).all(axis=1)
    return [int(x) if ok else None for x, ok in zip(h, full, strict=True)]


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def _survey(n: int, buckets: int):
    """Of (doc_id, text_hash, text): rows with class and size; rows with a bucket's repeated n-grams and counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("class", pa.int64()), ("size", pa.int32()), ("bands", pa.list_(pa.int64())), ("bucket", pa.int32()), ("grams", pa.binary())])

    def repeats(held: list[np.ndarray]) -> pa.RecordBatch | None:
        g = np.concatenate(held)
        held.clear()
        g.sort()
        same = g[1:] == g[:-1]
        g = g[np.append(same, False) | np.append(False, same)]
        begin = np.flatnonzero(np.diff(g, prepend=g[:1] ^ _U(1)))
        count = np.diff(np.append(begin, len(g))).astype(np.uint32)
        g = g[begin]
        bucket = (g % _U(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        g, count, bucket = g[order], count[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        blobs = [_pack(np.uint32(len(x)), x, y) for x, y in zip(np.split(g, cuts), np.split(count, cuts), strict=True)] if len(g) else []
        none = pa.nulls(len(blobs), pa.int64())
        names = bucket[np.concatenate([[0], cuts])] if len(g) else bucket
        return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(blobs), pa.int32()), pa.nulls(len(blobs), pa.list_(pa.int64())), pa.array(names), pa.array(blobs, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, seen = [], 0, set()
        for batch in batches:
            keys, sizes, kin = [None] * len(batch), [0] * len(batch), [None] * len(batch)
            for k, s in sets(batch.column(2), n):
                keys[k], sizes[k], kin[k] = set_key(s), len(s), bands(s)
                if keys[k] not in seen:
                    seen.add(keys[k])
                    held.append(s)
                    many += len(s)
                if many >= RUN:
                    yield repeats(held)
                    held, many, seen = [], 0, set()
            nulls = pa.nulls(len(batch), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(kin, pa.list_(pa.int64())), nulls, pa.nulls(len(batch), pa.binary())], schema=schema)
        if held:
            yield repeats(held)

    return lean(run)


def _add_up(table: pa.Table) -> pa.Table:
    """Heavy n-grams of a bucket."""
    g, c = [], []
    for raw in table.column("grams"):
        raw = raw.as_py()
        m = int(np.frombuffer(raw, np.uint32, 1)[0])
        g.append(np.frombuffer(raw, _U, m, 4))
        c.append(np.frombuffer(raw, np.uint32, m, 4 + 8 * m))
    g, at = np.unique(np.concatenate(g), return_inverse=True)
    c = np.bincount(at, np.concatenate(c)).astype(np.int64)
    heavy = c >= HEAVY
    return pa.table({"gram": pa.array(g[heavy].view(np.int64)), "count": pa.array(c[heavy])})


def _heavy(found: DataFrame) -> np.ndarray:
    """The heavy n-grams, by count and then by hash."""
    counts = cut(found.filter("bucket is not null").select("bucket", "grams").groupBy("bucket").applyInArrow(_add_up, "gram bigint, count bigint"))
    by_power = sorted(((r.p, r.n) for r in counts.groupBy(F.floor(F.log2("count")).alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, border = 0, None
    for p, n in by_power:
        if total + n > HEAVY_LIMIT:
            break
        total, border = total + n, 2**p
    if border is None:
        return np.zeros(0, _U)
    t = counts.filter(F.col("count") >= border).toArrow()
    g, c = t.column("gram").to_numpy().view(_U), t.column("count").to_numpy()
    return g[np.lexsort((g, c))]


def _kin(found: DataFrame) -> tuple[DataFrame, Broadcast]:
    """(node, root) of classes that are kin, and the larger groups as sorted classes and the number of each one's group."""
    by = found.filter("class is not null").select("class", F.explode("bands").alias("band")).filter("band is not null").distinct()
    least_of = by.groupBy("band").agg(F.min("class").alias("b"), F.count("*").alias("n")).filter("n > 1").select("band", "b")
    edges = by.join(least_of, "band").select(F.col("class").alias("a"), "b")
    related = cut(components(edges.filter("a != b")))
    sizes = related.groupBy("root").agg(F.count("*").alias("n"))
    by_power = sorted(((r.p, r.n) for r in sizes.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.sum("n").alias("n")).collect()), reverse=True)
    total, border = 0, None
    for p, n in by_power:
        if total + n > KIN_LIMIT:
            break
        total, border = total + n, 2**p
    known = group = np.zeros(0, np.int64)
    if border is not None:
        t = related.join(sizes.filter(F.col("n") >= border), "root").select("node", "root").toArrow()
        known, group = t.column("node").to_numpy(), np.unique(t.column("root").to_numpy(), return_inverse=True)[1]
        order = np.argsort(known)
        known, group = known[order], group[order]
    return related, found.sparkSession.sparkContext.broadcast((known, group))


class Order:
    """The global order of n-grams."""

    def __init__(self, heavy: np.ndarray):
        self.look = Lookup(heavy)
        self.rank = np.empty(len(heavy), _U)
        self.rank[np.searchsorted(self.look.keys, heavy)] = np.arange(len(heavy), dtype=_U)

    def tokens(self, s: np.ndarray) -> np.ndarray:
        """A set's n-grams as numbers in that order, sorted."""
        t = s >> _U(1)
        at, k = self.look.find(s)
        t[at] = self.rank[k] | _U(1 << 63)
        t.sort()
        return t


def _prefixes(order: Broadcast, n: int, threshold: float, buckets: int):
    """Of (text): for each bucket the classes, sizes and prefix tokens that fall into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in (b.column(0).slice(a, SLICE) for b in batches for a in range(0, len(b), SLICE)):
            tokens, places, keys, sizes, seen = [], [], [], [], set()
            for _, s in sets(texts, n):
                key = set_key(s)
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sizes.append(len(s))
                    tokens.append(order.value.tokens(s)[: len(s) - int(least(len(s), threshold)) + 1])
                    places.append(np.arange(len(tokens[-1])) * 256 // len(s))
            if not keys:
                continue
            token, owner = np.concatenate(tokens), np.repeat(np.arange(len(keys), dtype=np.int32), [len(t) for t in tokens])
            place = np.concatenate(places).astype(np.uint8)
            key, size = np.array(keys, np.int64), np.array(sizes, np.uint32)
            token = mix64(token)
            bucket = ((token >> _U(32)) % _U(buckets)).astype(np.int32)
            token = token.astype(np.uint32)
            by = np.argsort(bucket, kind="stable")
            token, owner, place, bucket = token[by], owner[by], place[by], bucket[by]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            blobs = []
            for t, o, at in zip(np.split(token, cuts), np.split(owner, cuts), np.split(place, cuts), strict=True):
                begin = np.flatnonzero(np.diff(o, prepend=-1))
                own = o[begin]
                length = np.diff(np.append(begin, len(o)))
                # One byte a length: a longer one is told in parts.
                parts = (length - 1) // 255 + 1
                own = np.repeat(own, parts)
                length = np.where(np.arange(len(own)) + 1 == np.repeat(np.cumsum(parts), parts), np.repeat((length - 1) % 255 + 1, parts), 255)
                blobs.append(_pack(np.uint32(len(own)), key[own], size[own], length.astype(np.uint8), t, at))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[np.concatenate([[0], cuts])]), pa.array(blobs, pa.binary())], ["bucket", "lists"])

    return lean(run)


def _lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token, position, class and size of the entries of a bucket of which the token occurs in several classes."""
    token, place, key, size = [], [], [], []
    for raw in table.column("lists"):
        raw = raw.as_py()
        m = int(np.frombuffer(raw, np.uint32, 1)[0])
        length = np.frombuffer(raw, np.uint8, m, 4 + 12 * m)
        n = int(length.sum(dtype=np.int64))
        key.append(np.repeat(np.frombuffer(raw, np.int64, m, 4), length))
        size.append(np.repeat(np.frombuffer(raw, np.uint32, m, 4 + 8 * m), length))
        token.append(np.frombuffer(raw, np.uint32, n, 4 + 13 * m))
        place.append(np.frombuffer(raw, np.uint8, n, 4 + 13 * m + 4 * n))
    token, place, key, size = (np.concatenate(x) for x in (token, place, key, size))
    by = np.argsort(token)
    token = token[by]
    same = token[1:] == token[:-1]
    keep = np.append(same, False) | np.append(False, same)
    by = by[keep]
    return token[keep].astype(np.int64), place[by], key[by], size[by].astype(np.int64)


def _meet(kin: Broadcast, threshold: float, buckets: int):
    """Of a bucket's lists: pairs of classes that aren't kin and how many tokens they share there, by bucket of pairs; a
    pair may come several times, with a part of its tokens each."""
    c = threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(0.5)
        token, place, key, size = _lists(pa.Table.from_batches(batches))
        if not len(token):
            return
        # Classes are numbered by size, then key.
        classes, at, local = np.unique(key, return_index=True, return_inverse=True)
        by = np.argsort(size[at], kind="stable")
        classes, size_of, k = classes[by], size[at][by], len(by)
        number = np.empty(k, np.int64)
        number[by] = np.arange(k)
        local = number[local]
        known, group = kin.value
        root = np.arange(k)
        if len(known):
            spot = np.minimum(np.searchsorted(known, classes), len(known) - 1)
            root = np.where(known[spot] == classes, k + group[spot], root)
        # Lists by token, block of positions, class. A class has a token twice only where two n-grams fall together.
        block = place.astype(np.int64) * BLOCKS // 256
        by = np.lexsort((local, block, token))
        token, block, local, place = token[by], block[by], local[by], place[by]
        begin = np.flatnonzero((np.diff(token, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        runs = np.cumsum(np.isin(np.arange(len(token)), begin, assume_unique=True)) - 1
        keys, runs_of = runs * k + local, np.searchsorted(token[begin], token, side="right") - np.searchsorted(token[begin], token)
        first_run = np.searchsorted(token[begin], token)
        own = size_of[local]
        # A partner comes before the entry in size, and is of the least size that it admits at least; what follows either's position has to suffice.
        low = least(own, threshold)
        high = np.minimum(local, np.searchsorted(size_of, own * (1 - place / 256) / c - own + 1e-6, side="right"))
        spare = 1 - c - block[begin] / BLOCKS
        found, counts, a, held = [], [], 0, 0
        upto = np.concatenate([[0], np.cumsum(runs_of)])

        def count(x: np.ndarray, start: np.ndarray, many: np.ndarray) -> None:
            y = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())
            p, q = local[y], np.repeat(local[x], many)
            other = root[p] != root[q]
            pair, n = np.unique(p[other] * k + q[other], return_counts=True)
            found.append(pair)
            counts.append(n)

        def summed() -> None:
            pair, at = np.unique(np.concatenate(found), return_inverse=True)
            found[:], counts[:] = [pair], [np.bincount(at, np.concatenate(counts)).astype(np.int64)]

        def passed_on() -> pa.RecordBatch:
            pair, shared = found.pop(), np.minimum(counts.pop(), 65535).astype(np.uint16)
            p, q = pair // k, pair % k
            ka, kb = np.minimum(classes[p], classes[q]), np.maximum(classes[p], classes[q])
            sa, sb = (np.minimum(size_of[np.where(classes[p] == x, p, q)], 65535).astype(np.uint16) for x in (ka, kb))
            bucket = (mix64(ka.view(_U) ^ mix64(kb.view(_U))) % _U(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            parts = np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1)
            blobs = [_pack(np.uint32(len(r)), ka[r], kb[r], sa[r], sb[r], shared[r]) for r in parts]
            return pa.RecordBatch.from_arrays([pa.array(bucket[[r[0] for r in parts]]), pa.array(blobs, pa.binary())], ["bucket", "pairs"])

        while a < len(token):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, side="right")) - 1)
            x = np.repeat(np.arange(a, b), runs_of[a:b])
            r = first_run[x] + np.arange(len(x)) - np.repeat(upto[a:b] - upto[a], runs_of[a:b])
            with np.errstate(divide="ignore"):
                by_place = np.where(spare[r] > 0, c * own[x] / spare[r] - 1e-6, np.inf)
            start = np.searchsorted(keys, r * k + np.searchsorted(size_of, np.maximum(low[x], by_place)))
            many = np.searchsorted(keys, r * k + high[x]) - start
            some = many > 0
            x, start, many = x[some], start[some], many[some]
            pairs_upto, u = np.concatenate([[0], np.cumsum(many)]), 0
            while u < len(x):
                v = max(u + 1, int(np.searchsorted(pairs_upto, pairs_upto[u] + PAIRS, side="right")) - 1)
                count(x[u:v], start[u:v], many[u:v])
                held += len(found[-1])
                if held >= HELD:
                    summed()
                    held = len(found[0])
                    if held >= HELD // 2:
                        yield passed_on()
                        held = 0
                u = v
            a = b
        if held:
            summed()
            yield passed_on()

    return run


def _sift(threshold: float):
    """Of a bucket of pairs: edges of a forest that connects those which could reach the threshold."""

    def passed(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.lexsort((b, a))
        a, b, sa, sb, count = a[by], b[by], sa[by], sb[by], count[by]
        begin = np.flatnonzero((np.diff(a, prepend=a[0] ^ 1) != 0) | (np.diff(b, prepend=b[0] ^ 1) != 0))
        count = np.add.reduceat(count, begin)
        a, b, sa, sb = a[begin], b[begin], sa[begin], sb[begin]
        # Beyond the prefixes, the one that ends first in the order leaves at most its own rest.
        rest = np.maximum(least(sa, threshold), least(sb, threshold)) - 1
        need = np.ceil(threshold / (1 + threshold) * (sa + sb) - 1e-9)
        ok = (count + rest >= need) | (np.maximum(sa, sb) == 65535)
        return a[ok], b[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(0.5)
        raws, many, node, root = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(batch.schema.get_field_index("pairs")):
                raw = raw.as_py()
                m = int(np.frombuffer(raw, np.uint32, 1)[0])
                raws.append((np.frombuffer(raw, np.int64, m, 4), np.frombuffer(raw, np.int64, m, 4 + 8 * m), *(np.frombuffer(raw, np.uint16, m, 4 + (16 + 2 * i) * m) for i in range(3))))
                many += m
        # All of a pair is in one part; as many are sifted at once as is held.
        parts = many // HELD + 1
        of = [(mix64(mix64(x[0].view(_U)) ^ x[1].view(_U)) >> _U(32)) % _U(parts) for x in raws] if parts > 1 else None
        for part in range(parts):
            mine = raws if of is None else [tuple(c[p == _U(part)] for c in x) for x, p in zip(raws, of, strict=True)]
            columns = [np.concatenate(x).astype(np.int64) for x in zip(*mine, strict=True)]
            if len(columns[0]):
                a, b = passed(*columns)
                node, root = roots(np.concatenate([node, a]), np.concatenate([root, b])) if len(a) or len(node) else (node, root)
                node, root = node[node != root], root[node != root]
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["a", "b"])

    return run


def _bloom(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    for x in _bloom_places(hashes):
        np.bitwise_or.at(bits, x >> 3, np.uint8(1) << (x & 7).astype(np.uint8))
    return bits


def _bloom_places(hashes: np.ndarray) -> list[np.ndarray]:
    h = mix64(hashes.view(_U))
    return [(h >> _U(64 - BLOOM_BITS)).astype(np.int64), (h & _U((1 << BLOOM_BITS) - 1)).astype(np.int64)]


def _some_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    for batch in batches:
        bits |= _bloom(batch.column(0).to_numpy())
    at = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].astype(np.int16))], ["at", "bits"])


def _whole(order: Broadcast, wanted: Broadcast, n: int):
    """Of (text_hash, text): class and whole set of the texts that are wanted, and of a few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy()
            ok = np.ones(len(h), np.bool_)
            for x in _bloom_places(h):
                ok &= (wanted.value[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(np.bool_)
            keys, raw, seen = [], [], set()
            for _, s in sets(batch.column(1).filter(pa.array(ok)), n):
                key = set_key(s)
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    raw.append(order.value.tokens(s).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(raw, pa.binary())], ["class", "grams"])

    return lean(run)


def _met(key: tuple, table: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of a task's classes: their keys, the rows that tell of them, and the pairs i, j and their similarity, in portions."""
    tidy(0.5)
    keys, first = np.unique(table.column("class").to_numpy(), return_index=True)
    raw = table.column("grams")
    grams = [np.frombuffer(raw[int(k)].as_py(), _U) for k in first]
    side = table.column("side").to_numpy()[first] if key[1] != key[2] else None

    def portions() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i, j, s in [few_join(grams, threshold)] if len(keys) <= FEW else jaccard_portions(grams, threshold):
            yield (i, j, s) if side is None else tuple(x[side[i] != side[j]] for x in (i, j, s))

    return keys, first, portions()


def _join(threshold: float):
    """Of a task's classes: its pairs."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, _, pairs = _met(tuple(k.as_py() for k in key), pa.Table.from_batches(batches), threshold)
        for i, j, s in pairs:
            yield pa.RecordBatch.from_arrays([pa.array(keys[i]), pa.array(keys[j]), pa.array(s)], ["a", "b", "jaccard"])

    return run


def _count(threshold: float):
    """Of a task's classes that are in a pair: the least class they are connected with there, and the documents that their pairs lead to."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, first, pairs = _met(tuple(k.as_py() for k in key), table, threshold)
        many = table.column("many").to_numpy()[first]
        node, root = np.zeros(0, np.int64), np.zeros(0, np.int64)
        links = np.zeros(len(keys))
        for i, j, _ in pairs:
            links += np.bincount(i, many[j], len(keys)) + np.bincount(j, many[i], len(keys))
            node, root = roots(np.concatenate([node, i]), np.concatenate([root, j]))
        return pa.table({"class": pa.array(keys[node]), "root": pa.array(keys[root]), "links": pa.array(links[node].astype(np.int64)), "cut": pa.array(table.column("sides").to_numpy()[first[node]] > 1)})

    return run


def _tasks(docs: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame, list[Broadcast]]:
    """The documents as (doc_id, text_hash, class, size); what meets in the tasks of step 3, by (root, p, q); the broadcasts it needs."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("the threshold is in (0, 1], n at least 1")
    spark = docs.sparkSession
    ship(spark)
    buckets = max(BUCKETS, partitions(spark))
    rows = docs.select(col("doc_id").cast("bigint").alias("doc_id"), col("text").cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "text_hash", "text")
    found = cut(rows.mapInArrow(_survey(n, buckets), "doc_id bigint, text_hash bigint, class bigint, size int, bands array<bigint>, bucket int, grams binary"))
    of = found.filter("bucket is null").select("doc_id", "text_hash", "class", "size")
    order = spark.sparkContext.broadcast(Order(_heavy(found)))
    buckets = max(buckets, (of.agg(F.sum(F.col("size").cast("bigint"))).first()[0] or 0) // BUCKET_GRAMS)

    lists = rows.select("text").mapInArrow(_prefixes(order, n, threshold, buckets), "bucket int, lists binary")
    related, kin = _kin(found)
    pairs = lists.groupBy("bucket").applyInArrow(_meet(kin, threshold, buckets), "bucket int, pairs binary")
    edges = pairs.groupBy("bucket").applyInArrow(_sift(threshold), "a bigint, b bigint")
    parts = cut(components(edges.union(related.select("node", "root"))))

    kin.destroy()
    classes = of.filter("class is not null").groupBy("class").agg(F.min("text_hash").alias("text_hash"), F.max("size").alias("size"), F.countDistinct("doc_id").alias("many"))
    placed = cut(parts.join(classes, parts.node == classes["class"]).select("class", "root", "size", "many", "text_hash"))
    bits = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    some = placed.select("text_hash").coalesce(8).mapInArrow(_some_hashes, "at bigint, bits smallint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits[some.column("at").to_numpy()] = some.column("bits").to_numpy().astype(np.uint8)
    wanted = spark.sparkContext.broadcast(bits)
    whole = rows.select("text_hash", "text").filter("text is not null").mapInArrow(_whole(order, wanted, n), "class bigint, grams binary")

    # A component of more n-grams than a task should have is cut: sides of the grid by class, a task for each two.
    sides = placed.groupBy("root").agg(F.sum(F.col("size").cast("bigint")).alias("total")).select("root", F.expr(f"cast((total - 1) div {TASK_GRAMS} + 1 as int)").alias("sides"))
    spread = placed.join(sides, "root").withColumn("side", F.expr("cast(pmod(xxhash64(class), sides) as int)"))
    spread = spread.select("class", "root", "many", "side", "sides", F.explode(F.expr("sequence(0, sides - 1)")).alias("other"))
    spread = spread.select("class", "root", "many", "side", "sides", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"))
    return of, whole.join(spread, "class").select("class", "grams", "root", "many", "side", "sides", "p", "q"), [order, wanted]


def _through(tasks: DataFrame, of_task, schema: str, shared: list[Broadcast]) -> DataFrame:
    """What the tasks give, written, so that their broadcasts can go."""
    out = cut(tasks.groupBy("root", "p", "q").applyInArrow(of_task, schema))
    for b in shared:
        b.destroy()
    return out


def class_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_id, text_hash, class, size), and the pairs of classes (a, b, jaccard), a < b."""
    of, tasks, shared = _tasks(docs, n, threshold)
    return of, _through(tasks, _join(threshold), "a bigint, b bigint, jaccard double", shared)


def class_links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_id, text_hash, class, size), and (class, root, links) of the classes that are in a pair:
    the least class that pairs connect it with, and how many documents its pairs lead to. Pairs are counted, not written.
    """
    of, tasks, shared = _tasks(docs, n, threshold)
    parts = _through(tasks, _count(threshold), "class bigint, root bigint, links bigint, cut boolean", shared)
    done = parts.filter("not cut").select("class", "root", "links")
    split = parts.filter("cut")
    if split.isEmpty():
        return of, done
    # Components that met in several tasks: what the tasks connect is connected, their counts add up.
    whole = components(split.select(F.col("class").alias("a"), F.col("root").alias("b")))
    return of, done.unionByName(split.groupBy("class").agg(F.sum("links").alias("links")).join(whole, F.col("class") == F.col("node")).select("class", "root", "links"))


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, class_id, n_links), one for each document: see above."""
    of, found = class_links(docs, n, threshold)
    of = of.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "class").distinct()
    return rows_of(of, found).withColumnRenamed("id", "doc_id")


def similar(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_a, doc_b, jaccard), doc_a < doc_b: see above."""
    of, pairs = class_pairs(docs, n, threshold)
    of = of.filter("class is not null and doc_id is not null").select("doc_id", "class").distinct()
    firsts = of.groupBy("class").agg(F.min("doc_id").alias("first"))
    equal = of.join(firsts, "class").filter("doc_id > first").select(F.col("first").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    x, y = firsts.toDF("a", "first_a"), firsts.toDF("b", "first_b")
    near = pairs.join(x, "a").join(y, "b").filter("first_a != first_b")
    near = near.select(F.least("first_a", "first_b").alias("doc_a"), F.greatest("first_a", "first_b").alias("doc_b"), "jaccard")
    return equal.unionByName(near)


def expand(joined: DataFrame) -> DataFrame:
    """All pairs of documents of a result of similar()."""
    equal = joined.filter("jaccard = 1").select(F.col("doc_a").alias("first"), F.col("doc_b").alias("doc"))
    all_of = equal.union(equal.select("first", F.col("first").alias("doc")).distinct())
    lone = joined.select(F.explode(F.array("doc_a", "doc_b")).alias("first")).distinct().join(equal.select(F.explode(F.array("first", "doc")).alias("first")).distinct(), "first", "left_anti")
    all_of = all_of.union(lone.select("first", F.col("first").alias("doc")))
    x, y = all_of.toDF("doc_a", "x"), all_of.toDF("doc_b", "y")
    out = joined.filter("jaccard < 1").join(x, "doc_a").join(y, "doc_b").select("x", "y", "jaccard")
    same = all_of.toDF("first", "x").join(all_of.toDF("first", "y"), "first").filter("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    return out.union(same).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")


#: Decisions are broadcast up to this many rows; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def deduplicate(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one of each group: of those that pairs connect the one with the least id stays.

    A document without an id comes after those with one. Equal rows (id and text) of the one that stays leave one.
    """
    of, found = class_links(docs, n, threshold)
    keyed = of.filter("class is not null").join(found.select("class", "root"), "class", "left").withColumn("group", F.coalesce("root", "class"))
    rows = keyed.groupBy("group", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    stays = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")).alias("stay"), F.sum("n").alias("all")).filter("all > 1")
    decided = rows.join(stays, "group").select("doc_id", "text_hash", F.when((F.col("stay.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("stay.text_hash") == F.col("text_hash")), F.when(F.col("n") > 1, "one").otherwise("stay")).otherwise("go").alias("what"))
    decided = cut(decided.filter("what != 'stay'"))
    counts = {r.what: r["count"] for r in decided.groupBy("what").count().collect()}
    h, i, t, what = fresh(docs, "_hash", "_id", "_text_hash", "_what")
    decided = decided.toDF(i, t, what)
    if sum(counts.values()) <= BROADCAST_ROWS:
        decided = F.broadcast(decided)
    marked = docs.withColumn(h, F.xxhash64(F.coalesce(col("text").cast("string"), F.lit(""))))
    joined = marked.join(decided, (F.col(h) == F.col(t)) & col("doc_id").cast("bigint").eqNullSafe(F.col(i)), "left")
    out = joined.filter(F.col(what).isNull()).select(*[col(c) for c in docs.columns])
    if counts.get("one"):
        again = joined.filter(F.col(what) == "one").dropDuplicates([i, t]).select(*[col(c) for c in docs.columns])
        out = out.union(again)
    return out


def oracle(n: int = N, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for links(): all pairs of classes that share an n-gram, counted, and what they connect."""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) < {n} THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - {n} + 2), lambda i: array_to_string(words[i:i + {n - 1}], ' ')) END)) AS grams
  FROM w WHERE len(words) > 0
), c AS (
  SELECT *, min(doc_id) OVER (PARTITION BY grams) AS first, count(*) OVER (PARTITION BY grams) AS many FROM s
), g AS (
  SELECT doc_id, many, unnest(grams) AS gram, len(grams) AS size FROM c WHERE doc_id = first
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(y.many) AS many, count(*) AS shared, any_value(x.size) AS sx, any_value(y.size) AS sy
  FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b, many FROM p WHERE shared::DOUBLE / (sx + sy - shared) >= {threshold} - 1e-12
), r AS (
  SELECT DISTINCT first AS node, first AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a WHERE r.root < e.b
), l AS (
  SELECT node, min(root) AS root FROM r GROUP BY node
), k AS (
  SELECT a, sum(many) AS links FROM e GROUP BY a
)
SELECT d.doc_id, coalesce(l.root, d.doc_id) AS class_id, coalesce(c.many - 1 + coalesce(k.links, 0), 0)::BIGINT AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN c ON c.doc_id = d.doc_id
LEFT JOIN l ON l.node = c.first LEFT JOIN k ON k.a = c.first"""
