"""Quality classifier: a convolutional network over bytes, in numpy.

Each byte has a learned vector of DIMS numbers. A filter looks at WIDTH bytes, at every STRIDE-th byte of the text; its
answer goes through a rectifier. Chunks of CHUNK bytes overlap by half and cover the whole text; in each a filter's
greatest answer counts. A text's features are, for each filter, the greatest over its chunks and the mean over them.
A logistic unit makes one probability of these.

The network is trained here, by gradient descent with momentum estimates, on SAMPLE_ROWS labelled texts at most, chosen
by hash; whole texts train it, and the seed is fixed, so equal data give an equal network. Scoring is a map over the scan
without any shuffle; long texts go through in turns of bounded size, in training as in scoring.

Defined cases: a null text has a null probability; an empty one is scored as bytes of padding; labels that are null,
and ids whose labels contradict each other, train nothing; without labels of two kinds the probability is the share of
good ones, 0.5 without any; repeated rows give repeated rows and null ids stay null; an empty table gives an empty result.
Other columns don't matter, not even one named `quality`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import col, ship

DIMS, WIDTH, STRIDE, FILTERS = 8, 8, 2, 32
CHUNK = 1024
SAMPLE_ROWS = 3000
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.01, 7
#: Bytes of text that are convolved at once.
TURN = 1 << 18
_CELL = CHUNK // 2


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.byte = r.normal(0, 0.5, (256, DIMS)).astype(np.float32)
        self.filter = r.normal(0, (WIDTH * DIMS) ** -0.5, (WIDTH * DIMS, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(2 * FILTERS, np.float32)
        self.base = np.zeros(1, np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.byte, self.filter, self.bias, self.out, self.base]

    def _windows(self, raw: np.ndarray) -> np.ndarray:
        """Vectors of the bytes under each window."""
        v = self.byte[raw].reshape(-1)
        n = (len(raw) - WIDTH) // STRIDE + 1
        return np.lib.stride_tricks.as_strided(v, (n, WIDTH * DIMS), (STRIDE * DIMS * 4, 4))

    def _answers(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Answers of the filters to each window, before the rectifier; raw is whole cells and WIDTH - STRIDE bytes of what
        follows. Where a text ends, within raw, its last windows reach into padding, not into the next text."""
        out = self._windows(raw) @ self.filter + self.bias
        if len(ends):
            start = (ends[:, None] - np.arange(WIDTH - STRIDE, 0, -STRIDE)).reshape(-1)
            under = self.byte[_under(raw, ends, start)].reshape(-1, WIDTH * DIMS)
            out[start // STRIDE] = under @ self.filter + self.bias
        return out

    def cells(self, raw: np.ndarray, ends: np.ndarray = np.zeros(0, np.int64)) -> np.ndarray:
        """Greatest answers of the filters in each half chunk."""
        return np.maximum(self._answers(raw, ends), 0).reshape(-1, _CELL // STRIDE, FILTERS).max(axis=1)

    def features(self, cells: np.ndarray) -> np.ndarray:
        """Of one text: a chunk is two cells in a row."""
        chunks = np.maximum(cells[1:], cells[:-1]) if len(cells) > 1 else cells
        return np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)])

    def score(self, texts: list[str | None]) -> list[float | None]:
        out: list[float | None] = [None] * len(texts)
        held, size = [], 0

        def flush() -> None:
            c = self.cells(np.concatenate([*(p for _, p in held), np.zeros(WIDTH - STRIDE, np.uint8)]), np.cumsum([len(p) for _, p in held]))
            at = 0
            for i, p in held:
                n = len(p) // _CELL
                out[i] = self.probability(self.features(c[at : at + n]))
                at += n

        for i, t in enumerate(texts):
            if t is None:
                continue
            p = padded(t)
            if len(p) > TURN:
                tail = np.concatenate([p, np.zeros(WIDTH - STRIDE, np.uint8)])
                step = TURN // _CELL * _CELL
                c = np.concatenate([self.cells(tail[a : min(a + step, len(p)) + WIDTH - STRIDE]) for a in range(0, len(p), step)])
                out[i] = self.probability(self.features(c))
                continue
            if held and size + len(p) > TURN:
                flush()
                held, size = [], 0
            held.append((i, p))
            size += len(p)
        if held:
            flush()
        return out

    def probability(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(float(f @ self.out + self.base[0]), -30, 30))))

    def gradients(self, raws: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss over texts; only windows with a chunk's greatest answer have a part in it."""
        raw = np.concatenate([*raws, np.zeros(WIDTH - STRIDE, np.uint8)])
        n_cells, per = (len(raw) - (WIDTH - STRIDE)) // _CELL, _CELL // STRIDE
        ends = np.cumsum([len(p) for p in raws])
        where, top = np.empty((n_cells, FILTERS), np.int64), np.empty((n_cells, FILTERS), np.float32)
        for a in range(0, n_cells, TURN // _CELL):
            b = min(n_cells, a + TURN // _CELL)
            own = ends[(ends > a * _CELL) & (ends <= b * _CELL)] - a * _CELL
            answers = self._answers(raw[a * _CELL : b * _CELL + WIDTH - STRIDE], own).reshape(b - a, per, FILTERS)
            where[a:b] = answers.argmax(axis=1)
            top[a:b] = np.take_along_axis(answers, where[a:b, None], axis=1)[:, 0]
        where += np.arange(n_cells)[:, None] * per
        g = [np.zeros_like(p) for p in self.parts()]
        d_cells = np.zeros_like(top)
        at = 0
        for p, label in zip(raws, y, strict=True):
            n = len(p) // _CELL
            c = np.maximum(top[at : at + n], 0)
            m = max(1, n - 1)
            second = np.zeros((m, FILTERS), np.int64) if n == 1 else (c[1:] > c[:-1]).astype(np.int64)
            cell = np.arange(m)[:, None] + second
            chunks = np.take_along_axis(c, cell, axis=0)
            best = chunks.argmax(axis=0)
            f = np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)])
            e = (self.probability(f) - label) / len(raws)
            g[3] += e * f
            g[4] += e
            d = np.full((m, FILTERS), e * self.out[FILTERS:] / m, np.float32)
            d[best, np.arange(FILTERS)] += e * self.out[:FILTERS]
            # A cell is the greater one of the chunk that it begins, or of the one that it ends.
            d_cells[at : at + m] += np.where(second == 0, d, 0)
            if n > 1:
                d_cells[at + 1 : at + 1 + m] += np.where(second == 1, d, 0)
            at += n
        d_cells[top <= 0] = 0
        g[2] += d_cells.sum(axis=0)
        cell, k = np.nonzero(d_cells)
        by = np.argsort(k, kind="stable")
        cell, k = cell[by], k[by]
        under = _under(raw, ends, where[cell, k] * STRIDE)
        d = d_cells[cell, k]
        first = np.searchsorted(k, np.arange(FILTERS + 1))
        for f in range(FILTERS):
            r = slice(first[f], first[f + 1])
            g[1][:, f] = d[r] @ self.byte[under[r]].reshape(-1, WIDTH * DIMS)
        # A byte's vector gets, for each place under a filter that it stands at, that place's part of the filter.
        places = (np.arange(WIDTH) * FILTERS + k[:, None]) * 256 + under
        weight = np.bincount(places.reshape(-1), np.repeat(d, WIDTH), WIDTH * FILTERS * 256).reshape(WIDTH, FILTERS, 256)
        g[0] += np.einsum("wfb,wdf->bd", weight, self.filter.reshape(WIDTH, DIMS, FILTERS)).astype(np.float32)
        return g


def _under(raw: np.ndarray, ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Bytes under windows that begin at start, 0 beyond the end of their text."""
    place = start[:, None] + np.arange(WIDTH)
    return np.where(place < ends[np.searchsorted(ends, start, side="right")][:, None], raw[place], 0)


def padded(text: str) -> np.ndarray:
    """UTF-8 bytes, filled up with 0 to whole cells."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.concatenate([b, np.zeros(-len(b) % _CELL if len(b) else _CELL, np.uint8)])


class Constant:
    """What there is without labels of two kinds."""

    def __init__(self, value: float):
        self.value = value

    def score(self, texts: list[str | None]) -> list[float | None]:
        return [None if t is None else self.value for t in texts]


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network | Constant:
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return Constant(float(y.mean()) if len(y) else 0.5)
    net, r = Network(seed), np.random.default_rng(seed)
    raws = [padded(t) for t in texts]
    net.base[0] = np.log(y.mean() / (1 - y.mean()))
    first, second, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    total = epochs * -(-len(raws) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(raws))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            some = [raws[k] for k in rows]
            step += 1
            rate = RATE * (1 - (step - 1) / total)
            for p, g, m, v in zip(net.parts(), net.gradients(some, y[rows]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[list[str], list[int]]:
    """Texts and labels of the labelled ids that come first by hash."""
    one = labels.select(col("doc_id").cast("bigint").alias("doc_id"), col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    one = one.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "label")
    texts = docs.select(col("doc_id").cast("bigint").alias("doc_id"), col("text").cast("string").alias("text")).filter("text is not null")
    # An id that occurs more than once counts with its least text; SAMPLE_ROWS ids are small enough to broadcast.
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).collect()
    found.sort(key=lambda r: r.doc_id)
    return [r.text for r in found], [r.label for r in found]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Network | Constant:
    return fit(*sample(docs, labels, label, rows))


def score(docs: DataFrame, model: Network | Constant) -> DataFrame:
    """doc_id, quality: the probability of good quality."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "quality"])

    return docs.select(col("doc_id").cast("bigint").alias("doc_id"), col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, quality double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
