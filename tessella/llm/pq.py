"""Near duplicates among embeddings by product quantisation.

Vectors are brought to length 1. Centroids cut space into lists, in one or two levels: cells of coarse centroids, and in
each cell those of residual centroids that all cells share, so that lists stay short however many vectors there are. What
is left beyond the list's centre is coded in SUBSPACES parts, each by the nearest of 256 learned codes. Every vector is
indexed and is a query:

1. Codes, not vectors, go to other lists. A vector's exact copy goes to its own list alone; its code goes there and to
   the lists whose members might be its partners: a vector at distance r or less in a random direction lies beyond the
   border of a cell by r / sqrt(dims) in the mean square, so all cells whose border is no farther than MARGIN times that
   get the code. There is no cap on them. A pair is looked for in its lower list, so it is found once.
2. In a list the distance of query and code comes from tables of the query's products with the codes of each subspace
   (asymmetric). A code stays a candidate if that is within r plus its own coding error, which by the triangle
   inequality loses no pair.
3. Candidates of the same list get their exact cosine there, in double precision. For the others the query's vector
   goes, once, to each list that holds candidates of it, and meets their vectors there. THRESHOLD or more is a link.

links() gives a row for each vector: the least id of the group that links connect it with, and the number of its links.
Pairs are counted where they are found and never written out. near() gives pairs: equal vectors form a class of which the
least id is the first; (first, other, 1.0) for the others and a pair of firsts for each pair of classes.
Centroids and codes are learned on a sample of about SAMPLE vectors (SAMPLE_BYTES at most), chosen by hash, and broadcast.
A list that the sample says has more than PART members is cut: queries by part, codes go to each part.
What is missed by the probes is measured in the tests against brute force (recall).

Defined cases: null, empty and zero vectors, those with null, unordered (NaN) or infinite elements, and those whose squares
don't sum to a finite number above 0, have no links and are in no pair; vectors of different lengths are never compared;
rows without an id have no row and count for nothing; a repeated id with an equal vector counts once, one with several
vectors has a row for each; ties go to the least id; an empty table gives an empty result. Other columns don't matter,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import col, cut, ship
from tessella.llm.graph import components, roots, rows_of
from tessella.llm.words import mix64

THRESHOLD = 0.9
SAMPLE, SAMPLE_BYTES = 65_536, 1 << 26
SUBSPACES, CODES = 16, 256
MARGIN = 3.0
#: Members of a list, about; centroids of the first and of the second level at most.
LIST, COARSE, FINE = 256, 2048, 4096
ROUNDS = 8
#: Members of a part of a list, about; queries and codes that are compared at once.
PART, STEP, BLOCK = 1 << 14, 256, 4096
#: Classes of equal vectors are broadcast up to this many; beyond it vectors are joined with them by id.
COPIES = 1 << 20
_U = np.uint64
BLOBS = "dims int, list bigint, part int, home boolean, blob binary"
MET = "request boolean, dims int, list bigint, part int, blob binary"


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centroids**2).sum(axis=1) / 2
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (x[a : a + 4096] @ centroids.T - half).argmax(axis=1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids; deterministic: begins with rows at even distances. Without rows there is one, at 0."""
    if not len(x):
        return np.zeros((1, x.shape[1]), np.float32)
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(np.int64)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        by = np.argsort(own, kind="stable")
        begin = np.flatnonzero(np.diff(own[by], prepend=-1))
        c[own[by][begin]] = np.add.reduceat(x[by], begin, axis=0) / np.diff(np.append(begin, len(by)))[:, None]
    return np.unique(c, axis=0)


class Quantiser:
    """Centroids of lists and codes for vectors of one length. share: of all vectors, that the sample has."""

    def __init__(self, sample: np.ndarray, lists: int, share: float = 1.0):
        sample = np.asarray(sample, np.float32)
        self.dims = sample.shape[1]
        self.coarse = kmeans(sample, min(lists, COARSE))
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        fine = min(FINE, -(-lists // len(self.coarse))) if lists > COARSE else 1
        self.fine = kmeans(rest, fine) if fine > 1 else np.zeros((1, self.dims), np.float32)
        self.cuts = np.linspace(0, self.dims, min(SUBSPACES, self.dims) + 1).astype(int)
        own = self.place(sample)
        rest = sample - self.centre(own)
        self.codes = [kmeans(rest[:, a:b], CODES) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        some, many = np.unique(own, return_counts=True)
        parts = np.ceil(many / share / PART).astype(np.int64)
        self.cut, self.cut_parts = some[parts > 1], parts[parts > 1]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The list of each row."""
        k = _nearest(x, self.coarse)
        return k * len(self.fine) + (_nearest(x - self.coarse[k], self.fine) if len(self.fine) > 1 else 0)

    def centre(self, at: np.ndarray) -> np.ndarray:
        return self.coarse[at // len(self.fine)] + self.fine[at % len(self.fine)]

    def parts(self, at: np.ndarray) -> np.ndarray:
        """How many parts lists are cut into."""
        out = np.ones(len(at), np.int64)
        if len(self.cut) and len(at):
            k = np.minimum(np.searchsorted(self.cut, at), len(self.cut) - 1)
            out = np.where(self.cut[k] == at, self.cut_parts[k], 1)
        return out

    def subspaces(self) -> Iterator[tuple[int, slice, np.ndarray]]:
        for m, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            yield m, slice(a, b), self.codes[m]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, coding error, and what the code adds to a squared distance whatever the query."""
        own = self.place(x)
        centre = self.centre(own)
        rest = x - centre
        code, error, own_part = np.empty((len(x), len(self.codes)), np.uint8), np.zeros(len(x)), np.zeros(len(x))
        for m, s, c in self.subspaces():
            code[:, m] = _nearest(rest[:, s], c)
            said = c[code[:, m]]
            error += ((rest[:, s] - said) ** 2).sum(axis=1)
            own_part += (said * (said + 2 * centre[:, s])).sum(axis=1)
        return own, code, np.sqrt(error).astype(np.float32), own_part.astype(np.float32)

    def probes(self, x: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists below its own in which each row may have partners."""
        reach, n = MARGIN * np.sqrt((2 - 2 * threshold) / self.dims), len(self.fine)
        rows, lists = [], []
        for a in range(0, len(x), 512):
            part, k0 = x[a : a + 512], own[a : a + 512] // n
            d = _squares(part, self.coarse)
            border = (d - d[np.arange(len(part)), k0][:, None]) / np.maximum(2 * np.sqrt(_squares(self.coarse[k0], self.coarse)), 1e-6)
            r, k = np.nonzero((border <= reach) & (np.arange(len(self.coarse)) <= k0[:, None]))
            if n > 1:
                d = _squares(part[r] - self.coarse[k], self.fine)
                s0 = d.argmin(axis=1)
                border = (d - d[np.arange(len(r)), s0][:, None]) / np.maximum(2 * np.sqrt(_squares(self.fine[s0], self.fine)), 1e-6)
                i, s = np.nonzero(border <= reach)
                r, k = r[i], k[i] * n + s
            ok = k < own[a : a + 512][r]
            rows.append(r[ok] + a)
            lists.append(k[ok])
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(lists or [np.zeros(0, int)])

    def search(self, queries: np.ndarray, at: np.ndarray, code: np.ndarray, error: np.ndarray, own_part: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) of the candidates among members of lists `at`, in steps."""
        limit = (np.sqrt(2 - 2 * threshold) + error + 1e-3).astype(np.float32) ** 2 - own_part
        lists, which = np.unique(at, return_inverse=True)
        centre = self.centre(lists)
        for a in range(0, len(queries), STEP):
            q = queries[a : a + STEP]
            tables = [np.ascontiguousarray((q[:, s] @ c.T).T) * np.float32(2) for _, s, c in self.subspaces()]
            base = _squares(centre, q).astype(np.float32)
            for b in range(0, len(code), BLOCK):
                total = base[which[b : b + BLOCK]]
                for m, t in enumerate(tables):
                    total -= t[code[b : b + BLOCK, m]]
                m, k = np.nonzero(total <= limit[b : b + BLOCK, None])
                yield k + a, m + b


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _sound(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a batch, by length: length, places of the rows with a vector that has a direction, and the vectors."""
    length = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for d in np.unique(length[length > 0]):
        at = np.flatnonzero(length == d)
        x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) + 0.0
        with np.errstate(all="ignore"):
            norm = (x.astype(np.float64) ** 2).sum(axis=1)
        ok = (norm > 0) & (norm < np.inf)
        if ok.any():
            yield int(d), at[ok], x[ok]


def _classes(x: np.ndarray) -> np.ndarray:
    """A hash of each vector."""
    return np.fromiter((int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "little", signed=True) for r in np.ascontiguousarray(x)), np.int64, len(x))


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.uint32(len(arrays[0])).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _unpack(blobs: list[bytes], *types: tuple[np.dtype, int]) -> list[np.ndarray]:
    """The arrays of blobs, put together; of each type with so many columns, 0 for a flat one."""
    parts: list[list[np.ndarray]] = [[] for _ in types]
    for raw in blobs:
        n, at = int(np.frombuffer(raw, np.uint32, 1)[0]), 4
        for out, (kind, width) in zip(parts, types, strict=True):
            x = np.frombuffer(raw, kind, n * max(1, width), at)
            out.append(x.reshape(n, width) if width else x)
            at += x.nbytes
    return [np.concatenate(p) if p else np.zeros((0, w) if w else 0, k) for p, (k, w) in zip(parts, types, strict=True)]


def _by(key: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys and where each one's rows begin in it."""
    by = np.lexsort(key[::-1])
    new = np.ones(len(by), np.bool_)
    new[1:] = np.logical_or.reduce([np.diff(k[by]) != 0 for k in key])
    return by, np.flatnonzero(new)


class _Index:
    """The steps in workers: quantisers by length, and classes of several documents (sorted) with their first and number."""

    def __init__(self, quantisers: dict[int, Quantiser], copies: tuple[np.ndarray, np.ndarray, np.ndarray] | None, kind: type, threshold: float, pairs: bool):
        self.z, self.copies, self.kind, self.threshold, self.pairs = quantisers, copies, np.dtype(kind), threshold, pairs

    def _firsts(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Length, classes, numbers of documents and vectors of the rows that stand for their class."""
        for d, at, x in _sound(batch.column(0), batch.column(1)):
            c, many = _classes(x), np.ones(len(x), np.int64)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
            if self.copies is None:
                ok, many = batch.column(2).to_numpy(zero_copy_only=False)[at] == c, batch.column(3).to_numpy(zero_copy_only=False)[at].astype(np.int64)
            else:
                known, first, number = self.copies
                k = np.minimum(np.searchsorted(known, c), max(0, len(known) - 1))
                hit = known[k] == c if len(known) else np.zeros(len(c), np.bool_)
                ok = ~hit
                ok[hit] = first[k[hit]] == ids[hit]
                many[hit] = number[k[hit]]
            _, one = np.unique(c[ok], return_index=True)
            yield d, c[ok][one], many[ok][one], x[ok][one]

    def place(self, codes: bool):
        """The blobs of batches: vectors in their own lists and, if asked for, codes where they may have partners."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for d, c, many, x in self._firsts(batch):
                    z = self.z[d]
                    f = _unit(x).astype(np.float32)
                    own, code, error, own_part = z.encode(f)
                    part = (mix64(c.view(_U)) % z.parts(own).astype(_U)).astype(np.int64)
                    by, begin = _by([own, part])
                    for r in np.split(by, begin[1:]) if len(by) else []:
                        out.append((d, own[r[0]], part[r[0]], True, _pack(c[r], many[r], x[r].astype(self.kind))))
                    if not codes:
                        continue
                    row, to = z.probes(f, own, self.threshold)
                    row, to = np.concatenate([np.arange(len(c)), row]), np.concatenate([own, to])
                    parts = z.parts(to)
                    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    row, to = np.repeat(row, parts), np.repeat(to, parts)
                    by, begin = _by([to, part])
                    for r in np.split(by, begin[1:]) if len(by) else []:
                        k = row[r]
                        out.append((d, to[r[0]], part[r[0]], False, _pack(c[k], own[k], error[k], own_part[k], code[k])))
                if out:
                    a = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int32()), pa.array(a[1], pa.int64()), pa.array(a[2], pa.int32()), pa.array(a[3], pa.bool_()), pa.array(a[4], pa.binary())], ["dims", "list", "part", "home", "blob"])

        return run

    def _home(self, blobs: list[bytes], d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c, many, x = _unpack(blobs, (np.int64, 0), (np.int64, 0), (self.kind, d))
        c, one = np.unique(c, return_index=True)
        return c, many[one], x[one]

    def _told(self, a: np.ndarray, b: np.ndarray, cosine: np.ndarray, many_a: np.ndarray, many_b: np.ndarray) -> bytes:
        """Pairs of classes as they are, or what they connect and how many documents they lead each to."""
        if self.pairs:
            return _pack(a, b, np.minimum(cosine, 1.0))
        node, root = roots(a, b)
        at, to = np.searchsorted(node, a), np.searchsorted(node, b)
        links = np.bincount(at, many_b, len(node)) + np.bincount(to, many_a, len(node))
        return _pack(node, root, links)

    def meet(self, key: tuple, table: pa.Table) -> pa.Table:
        """A list's part: what its pairs tell, and requests to other lists (or parts)."""
        d, at, part = (k.as_py() for k in key)
        z, home, blobs = self.z[d], table.column("home").to_pylist(), table.column("blob").to_pylist()
        c, many, x = self._home([b for b, h in zip(blobs, home, strict=True) if h], d)
        mc, ml, error, own_part, code = _unpack([b for b, h in zip(blobs, home, strict=True) if not h], (np.int64, 0), (np.int64, 0), (np.float32, 0), (np.float32, 0), (np.uint8, len(z.codes)))
        mc, one = np.unique(mc, return_index=True)
        ml, error, own_part, code = ml[one], error[one], own_part[one], code[one]
        out = []
        if len(c) and len(mc):
            unit = _unit(x)
            spot = np.minimum(np.searchsorted(c, mc), len(c) - 1)
            here, own = c[spot] == mc, ml == at
            near, asked = [], []
            for q, m in z.search(unit.astype(np.float32), ml, code, error, own_part, self.threshold):
                # A pair within the list is told once, by its lower class.
                ok = ~own[m] | (c[q] < mc[m])
                q, m = q[ok], m[ok]
                h = here[m]
                near.append(self._exact(unit, unit, q[h], spot[m[h]]))
                asked.append((q[~h], m[~h]))
            q, m, cosine = (np.concatenate(p) for p in zip(*near, strict=True))
            if len(q):
                out.append((False, d, at, part, self._told(c[q], c[m], cosine, many[q], many[m])))
            q, m = (np.concatenate(p) for p in zip(*asked, strict=True))
            if len(q):
                to, to_part = ml[m], (mix64(mc[m].view(_U)) % z.parts(ml[m]).astype(_U)).astype(np.int64)
                by, begin = _by([to, to_part])
                for r in np.split(by, begin[1:]):
                    some, of = np.unique(q[r], return_inverse=True)
                    blob = _pack(c[some], many[some], x[some]) + _pack(of.astype(np.int32), mc[m[r]])
                    out.append((True, d, to[r[0]], to_part[r[0]], blob))
        return _met(out)

    def _exact(self, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cosine = np.concatenate([np.zeros(0), *((x[i[a : a + 65536]] * y[j[a : a + 65536]]).sum(axis=1) for a in range(0, len(i), 65536))])
        good = cosine >= self.threshold
        return i[good], j[good], cosine[good]

    def answer(self, key: tuple, requests: pa.Table, homes: pa.Table) -> pa.Table:
        """What the queries that were sent to a list's part have in common with its vectors."""
        d, at, part = (k.as_py() for k in key)
        if not requests.num_rows:
            return _met([])
        c, many, x = self._home(homes.column("blob").to_pylist(), d)
        x, out = _unit(x), []
        for raw in requests.column("blob").to_pylist():
            n = int(np.frombuffer(raw, np.uint32, 1)[0])
            qc, qmany, qx = _unpack([raw], (np.int64, 0), (np.int64, 0), (self.kind, d))
            q, m = _unpack([raw[4 + n * (16 + d * self.kind.itemsize) :]], (np.int32, 0), (np.int64, 0))
            q, m, cosine = self._exact(_unit(qx), x, q, np.searchsorted(c, m))
            if len(q):
                out.append((False, d, at, part, self._told(qc[q], c[m], cosine, qmany[q], many[m])))
        return _met(out)

    def told(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of what was told."""
        for batch in batches:
            if self.pairs:
                a, b, cosine = _unpack(batch.column(0).to_pylist(), (np.int64, 0), (np.int64, 0), (np.float64, 0))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cosine)], ["a", "b", "cosine"])
            else:
                c, root, n = _unpack(batch.column(0).to_pylist(), (np.int64, 0), (np.int64, 0), (np.float64, 0))
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(root), pa.array(n.astype(np.int64))], ["class", "root", "links"])


def _met(out: list[tuple]) -> pa.Table:
    a = list(zip(*out, strict=True)) or [()] * 5
    return pa.table({"request": pa.array(a[0], pa.bool_()), "dims": pa.array(a[1], pa.int32()), "list": pa.array(a[2], pa.int64()), "part": pa.array(a[3], pa.int32()), "blob": pa.array(a[4], pa.binary())})


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, length and class of each row; null for both where the vector has no direction."""
    for batch in batches:
        dims, classes = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int64)
        for d, at, x in _sound(batch.column(0), batch.column(1)):
            dims[at], classes[at] = d, _classes(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, mask=dims == 0), pa.array(classes, mask=dims == 0)], ["id", "dims", "class"])


def _sampled(share: float):
    """Length, class and vector of about a share of the classes, by their hash; a class may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, _, x in _sound(batch.column(0), batch.column(1)):
                c, one = np.unique(_classes(x), return_index=True)
                ok = (mix64(c.view(_U)) >> _U(32)) < share * 2**32
                raw = [r.tobytes() for r in _unit(x[one[ok]]).astype(np.float32)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), d, np.int32)), pa.array(c[ok]), pa.array(raw, pa.binary())], ["dims", "class", "v"])

    return run


def _search(vectors: DataFrame, threshold: float, id: str, vector: str, pairs: bool) -> tuple[DataFrame, DataFrame]:
    """(id, class), distinct, class null without a direction; and what is found, of classes."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is in (0, 1]")
    spark = vectors.sparkSession
    ship(spark)
    kind = dict(vectors.dtypes)[vector]
    kind, as_type = (np.float32, "array<float>") if kind == "array<float>" else (np.float64, "array<double>")
    rows = vectors.select(col(id).cast("bigint").alias("id"), col(vector).cast(as_type).alias("v")).filter("id is not null")
    of = cut(rows.mapInArrow(_survey, "id bigint, dims int, class bigint").distinct())
    classes = of.filter("class is not null").groupBy("dims", "class").agg(F.min("id").alias("first"), F.count("*").alias("many"))
    sizes = {r.dims: r.n for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(sizes.values()))
    share = min(1.0, SAMPLE / total, SAMPLE_BYTES / max(1, sum(4 * d * n for d, n in sizes.items())))
    t = rows.mapInArrow(_sampled(share), "dims int, class bigint, v binary").dropDuplicates(["dims", "class"]).toArrow().sort_by("class")
    some: dict[int, list] = {d: [] for d in sizes}
    for d, v in zip(t.column("dims").to_pylist(), t.column("v").to_pylist(), strict=True):
        some[d].append(v)
    z = {d: Quantiser(np.frombuffer(b"".join(v), np.float32).reshape(-1, d), -(-sizes[d] // LIST), max(share, 1e-12)) for d, v in some.items()}
    several = classes.filter("many > 1")
    if several.count() <= COPIES:
        t = several.select("class", "first", "many").toArrow().sort_by("class")
        copies = tuple(t.column(c).to_numpy() for c in ("class", "first", "many"))
    else:
        copies = None
        rows = rows.join(classes.select(F.col("first").alias("id"), "class", "many"), "id").select("id", "v", "class", "many")
    index = spark.sparkContext.broadcast(_Index(z, copies, kind, threshold, pairs))

    def place(codes: bool):
        return lambda batches: index.value.place(codes)(batches)

    by = ["dims", "list", "part"]
    placed = rows.mapInArrow(place(True), BLOBS)
    met = cut(placed.groupBy(*by).applyInArrow(lambda key, table: index.value.meet(key, table), MET))
    homes = rows.mapInArrow(place(False), BLOBS).groupBy(*by)
    answered = met.filter("request").groupBy(*by).cogroup(homes).applyInArrow(lambda key, a, b: index.value.answer(key, a, b), MET)
    told = met.filter("not request").select("blob").unionByName(answered.select("blob"))
    found = cut(told.mapInArrow(lambda batches: index.value.told(batches), "a bigint, b bigint, cosine double" if pairs else "class bigint, root bigint, links bigint"))
    index.destroy()
    return of.select("id", "class"), found


def links(vectors: DataFrame, threshold: float = THRESHOLD, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, class_id, n_links): see above."""
    of, found = _search(vectors, threshold, id, vector, False)
    connected = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    found = found.groupBy("class").agg(F.sum("links").alias("links")).join(connected, F.col("class") == F.col("node")).select("class", "root", "links")
    return rows_of(of, found).withColumnRenamed("id", id)


def near(vectors: DataFrame, threshold: float = THRESHOLD, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_a, vec_b, cosine), vec_a < vec_b: see above."""
    of, found = _search(vectors, threshold, id, vector, True)
    firsts = of.filter("class is not null").groupBy("class").agg(F.min("id").alias("first"))
    equal = of.join(firsts, "class").filter("id > first").select(F.col("first").alias("vec_a"), F.col("id").alias("vec_b"), F.lit(1.0).alias("cosine"))
    both = found.join(firsts.toDF("a", "x"), "a").join(firsts.toDF("b", "y"), "b").filter("x != y")
    # An id with several vectors may meet another more than once: the greatest cosine counts.
    both = both.groupBy(F.least("x", "y").alias("vec_a"), F.greatest("x", "y").alias("vec_b")).agg(F.max("cosine").alias("cosine"))
    return equal.unionByName(both)
