"""The n-gram Jaccard join, decontamination and near duplicates of vectors against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import decontam, graph, jaccard, pq, setjoin
from tessella.llm.graph import components


def grams(text, n=jaccard.N):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w)} if 0 < len(w) < n else {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, t=jaccard.THRESHOLD):
    s = {}
    for i, text in rows:
        if i is not None and grams(text):
            s.setdefault(i, []).append(grams(text))
    out = {}
    ids = sorted(s)
    for x in ids:
        for y in ids:
            if x < y:
                best = max(len(a & b) / len(a | b) for a in s[x] for b in s[y])
                if best >= t:
                    out[x, y] = best
    return out


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["é%d" % i for i in range(20)]
    rows = []
    for g in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 4, 5, 30, 120, 300]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(r.choice([0, 0, 1, 2, 8])):
            w = list(words)
            for _ in range(r.choice([0, 0, 1, 3])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(w) + r.choice(["", ".", " "])))
    return rows


@pytest.mark.parametrize("threshold", [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.6, 0.9, 1.0])
def test_set_join_is_exact(threshold):
    r = np.random.default_rng(5)
    base = [np.unique(r.integers(0, 300, r.integers(1, 60))).astype(np.uint64) for _ in range(25)]
    sets = base + [np.setdiff1d(b, b[:: max(2, len(b) // 3)]) for b in base if len(b) > 3]
    want = {(i, j): len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(i + 1, len(sets))}
    want = {k: v for k, v in want.items() if v >= threshold - 1e-12}
    if threshold < 0.2:
        # A follower whose partner shares nothing with the leader.
        a = np.arange(1000, 1100, dtype=np.uint64)
        chain = [a, np.concatenate([a, np.arange(2000, 2010, dtype=np.uint64)]), np.arange(2000, 2010, dtype=np.uint64)]
        i, j, _ = setjoin.jaccard_join(chain, threshold)
        assert {(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True)} == {(0, 1)} | ({(1, 2)} if 10 / 110 >= threshold else set())
    for f in (setjoin.jaccard_join, setjoin.few_join):
        i, j, s = f(sets, threshold)
        assert {(a, b): c for a, b, c in zip(i.tolist(), j.tolist(), s.tolist(), strict=True)} == pytest.approx(want)


def test_pairs_of_a_large_cluster_are_not_held():
    """1,800 edited copies have 1.6 million pairs; a task counts them in portions."""
    base = np.arange(40, dtype=np.uint64)
    grams = [np.sort(np.append(np.delete(base, i % 40), np.uint64(1000 + i))) for i in range(1800)]
    table = pa.table({"class": pa.array(range(1800)), "grams": pa.array([g.tobytes() for g in grams], pa.binary()), "many": pa.array([1] * 1800), "side": pa.array([0] * 1800), "sides": pa.array([1] * 1800)})
    tracemalloc.start()
    try:
        setjoin.PORTION, old = 1 << 16, getattr(setjoin, "PORTION", None)
        got = jaccard._count(0.44)((pa.scalar(0), pa.scalar(0), pa.scalar(0)), table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        setjoin.PORTION = old
    assert got.column("links").to_pylist() == [1799] * 1800 and set(got.column("root").to_pylist()) == {0}
    assert peak < 40e6


@pytest.mark.parametrize("threshold", [0.1, 0.44])
def test_pairs_in_portions(spark, monkeypatch, threshold):
    """Buckets pass pairs on, and sift them, in small portions: the same rows."""
    rows = corpus(6, 30)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for where, name, value in ((jaccard, "HELD", 8), (setjoin, "PORTION", 4), (jaccard, "PAIRS", 16), (jaccard, "KIN_LIMIT", 0)):
        monkeypatch.setattr(where, name, value)
    got = jaccard.links(df, threshold=threshold).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == linked(rows, threshold)
    found = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.expand(jaccard.similar(df, threshold=threshold)).collect()}
    assert found == pytest.approx(brute(rows, threshold))


def test_jaccard_join_is_exact(spark):
    rows = corpus()
    rows += [(900, "..."), (901, ""), (902, None), (None, rows[0][1]), (rows[3][0], rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    joined = jaccard.similar(df)
    found = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.expand(joined).collect()}
    assert found == pytest.approx(brute(rows))
    assert jaccard.similar(df.limit(0)).count() == 0


def linked(rows, t=jaccard.THRESHOLD):
    """doc_id -> (class_id, n_links), by all pairs; ids are unique."""
    root = {i: i for i, _ in rows if i is not None}
    n = dict.fromkeys(root, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(rows, t):
        n[a] += 1
        n[b] += 1
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: (find(i), n[i]) for i in root}


@pytest.mark.parametrize("small", ["", "limits", "tasks"])
def test_links(spark, monkeypatch, small):
    rows = corpus(4, 40)
    if small == "limits":
        for name, value in (("HEAVY", 2), ("HEAVY_LIMIT", 3), ("KIN_LIMIT", 2), ("BUCKET_GRAMS", 100), ("RUN", 500), ("FEW", 0)):
            monkeypatch.setattr(jaccard, name, value)
        monkeypatch.setattr(graph, "ONE_TASK", 0)
    if small == "tasks":
        monkeypatch.setattr(jaccard, "TASK_GRAMS", 400)
        # A hot group: a third of all rows are copies, half of these edited.
        words = rows[0][1].split() + ["hot%d" % i for i in range(80)]
        rows += [(len(rows) + i, " ".join(words if i % 2 else [*words[:i], "x%d" % i, *words[i:]])) for i in range(len(rows) // 2)]
    rows += [(9000, "..."), (9001, ""), (9002, None), (None, rows[0][1])]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id bigint, text string, class string, `class_id` int, `a.b` int")
    got = jaccard.links(df).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == linked(rows) and len(got) == len(rows) - 1
    if not small:
        found = {(r.doc_a, r.doc_b) for r in jaccard.expand(jaccard.similar(df, threshold=0.1)).collect()}
        assert found == set(brute(rows, 0.1))
        again = jaccard.links(df.union(df)).collect()
        assert sorted(again) == sorted(got)
        assert jaccard.links(df.limit(0)).count() == 0
    else:
        assert sorted(r.doc_id for r in jaccard.deduplicate(df).collect() if r.doc_id is not None) == sorted({r for r, _ in linked(rows).values()})


def test_deduplication_keeps_one_of_each_group(spark):
    rows = corpus(2)
    full = [(i, t, 1) for i, t in rows] + [(None, rows[0][1], 2), (500, "zz yy xx", 3), (500, "zz yy xx", 3), (501, None, 4), (502, "", 5)]
    df = spark.createDataFrame(full, "doc_id bigint, text string, _HASH int")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in brute(rows):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = sorted([i for i, _ in rows if find(i) == i] + [500, 501, 502])
    got = jaccard.deduplicate(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == want
    assert not [r for r in got.collect() if r.doc_id is None]
    assert jaccard.deduplicate(df.limit(0)).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 5), (1, 1), (None, 2)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in components(e).collect() if r.node != 1} == {(3, 3), (4, 3), (5, 3), (8, 8), (9, 8)}


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_scores():
    r = np.random.default_rng(7)
    items = [r.integers(0, 6, r.integers(1, 30)).astype(np.uint64) + 2 for _ in range(60)]
    windows = [r.integers(0, 6, r.integers(1, 50)).astype(np.uint64) + 2 for _ in range(60)]
    assert decontam.local_align(items, windows)[0].tolist() == [smith_waterman(a, b) for a, b in zip(items, windows, strict=True)]


def test_decontamination(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(r.randrange(12, 40)))) for i in range(12)] + [(50, "too short"), (51, None), (0, None)]
    items.append(items[0])
    filler = lambda n: " ".join(word() for _ in range(n))
    docs, want = [(0, None), (1, ""), (2, filler(300))], set()
    for i, text in items[:12]:
        w = text.split()
        d = len(docs)
        docs.append((d, f"{filler(50)} {text.upper()}! {filler(60)}"))
        for k in range(0, len(w), 7):
            w[k] = word()
        docs.append((d + 1, f"{filler(20)} {' '.join(w)} {filler(20)}"))
        want |= {(d, i), (d + 1, i)}
    docs.append((len(docs), filler(150_000) + " " + items[3][1]))
    want.add((docs[-1][0], 3))
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.contaminated(df, b).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    texts = dict(docs)
    for x in got:
        a = [w.lower() for w in re.findall(r"\w+", texts[x.doc_id][x.start_char : x.end_char])]
        assert x.score == pytest.approx(smith_waterman(dict(items[:12])[x.item_id].split(), a) / 2 / len(dict(items[:12])[x.item_id].split()))
    kept = decontam.decontaminate(df, b)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i, _ in docs} - {d for d, _ in want}
    assert decontam.contaminated(df, b.limit(0)).count() == 0 and decontam.decontaminate(df, b.limit(0)).count() == len(docs)
    assert decontam.contaminated(df.limit(0), b).count() == 0


def test_decontamination_finds_all_alignments(spark):
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    common = [word() for _ in range(30)]
    items = [[r.choice(common) if r.random() < 0.4 else word() for _ in range(r.choice([8, 9, 20, 40]))] for _ in range(16)]

    def edited(w, kind):
        if kind in (3, 4, 5):
            return [word() if i % kind == kind - 1 else x for i, x in enumerate(w)]
        if kind == "inserted":
            return [y for x in w for y in (x, word())]
        if kind == "lost":
            return [x for i, x in enumerate(w) if i % 3]
        return [word() if r.random() < 0.3 else x for x in w] if kind == "random" else w

    docs = []
    for k, w in enumerate(items):
        # Half of the items have an exact copy beside the edited ones.
        for kind in (3, 4, 5, "inserted", "lost", "random", *["exact"] * (k % 2)):
            body = edited(w, kind)
            docs.append([r.choice(common) for _ in range(r.randrange(60))] + body + [word() for _ in range(r.randrange(60))])
    hashes = [np.array([hash(x) & (2**63 - 1) for x in w], np.uint64) for w in items + docs]
    pairs = [(d, i) for d in range(len(docs)) for i in range(len(items))]
    score = decontam.local_align([hashes[i] for _, i in pairs], [hashes[len(items) + d] for d, _ in pairs])[0]
    want = {p: s / 2 / len(items[p[1]]) for p, s in zip(pairs, score, strict=True) if s / 2 / len(items[p[1]]) >= decontam.THRESHOLD}
    assert len(want) >= 80
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id bigint, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    assert {(x.doc_id, x.item_id): x.score for x in decontam.contaminated(df, b).collect()} == pytest.approx(want)
    for t in (0.3, 0.45, 0.7, 1.0):
        want = {p: s / 2 / len(items[p[1]]) for p, s in zip(pairs, score, strict=True) if s / 2 / len(items[p[1]]) >= t}
        assert {(x.doc_id, x.item_id): x.score for x in decontam.contaminated(df, b, threshold=t).collect()} == pytest.approx(want)


def test_vector_pairs_recall(spark):
    r = np.random.default_rng(11)
    base = r.normal(size=(1500, 64))
    near = np.repeat(base[:60], 5, axis=0) + r.normal(size=(300, 64)) * r.choice([0.02, 0.2, 0.35, 0.45], 300)[:, None]
    x = np.concatenate([base, near, base[:20], base[:3]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [float("inf")] * 64), (None, rows[0][1]), (9005, [1.0, 2.0]), (9006, [1.0, 2.0]), (9007, [2.0, 4.001]), (0, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>")
    got = {(p.vec_a, p.vec_b): p.cosine for p in pq.near(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    first = {}
    for i, v in enumerate(x):
        first.setdefault(v.tobytes(), i)
    firsts = {first[v.tobytes()] for v in x}
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= pq.THRESHOLD and i in firsts and j in firsts}
    equal = {(first[v.tobytes()], i) for i, v in enumerate(x) if first[v.tobytes()] != i}
    small = {(9005, 9006), (9005, 9007)}
    assert equal | small <= set(got)
    rest = set(got) - equal - small
    assert rest <= want and len(rest) >= 0.95 * len(want)
    assert all(got[p] == pytest.approx(s[p]) for p in rest)
    assert pq.near(df.limit(0)).count() == 0


def vectors(seed=21, n=500):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, 24))
    hot = base[0] + r.normal(size=(n // 3, 24)) * 0.15
    near = np.repeat(base[:40], 4, axis=0) + r.normal(size=(160, 24)) * r.choice([0.02, 0.2, 0.35], 160)[:, None]
    return np.concatenate([base, hot, near, base[:30], base[:5], np.repeat(base[7:8], 50, axis=0)]).astype(np.float32)


def linked_vectors(x, t=pq.THRESHOLD):
    """(class_id, n_links) of each row, by all pairs."""
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    _, same = np.unique(x, axis=0, return_inverse=True)
    good = ((u @ u.T) >= t) | (same[:, None] == same[None])
    np.fill_diagonal(good, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(good, label[None], len(x)).min(axis=1))
        if np.array_equal(new, label):
            return list(zip(label.tolist(), good.sum(axis=1).tolist(), strict=True))
        label = new


@pytest.mark.parametrize("small", ["", "parts", "two levels", "joined", "sample"])
def test_vector_links_are_all_found_with_all_probes(spark, monkeypatch, small):
    monkeypatch.setattr(pq, "MARGIN", 100.0)
    monkeypatch.setattr(pq, "LIST", 16)
    for name, value in {"parts": {"PART": 8}, "two levels": {"COARSE": 5, "FINE": 4}, "joined": {"COPIES": 0}, "sample": {"SAMPLE": 40}}.get(small, {}).items():
        monkeypatch.setattr(pq, name, value)
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist(), 1, "a", 2) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, class int, `n.links` string, class_id int")
    odd = [(9000, None), (9001, []), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [float("inf")] * 24), (None, x[0].tolist()), (9005, [1.0, 2.0]), (9006, [1.0, 2.0]), (9007, [2.0, 4.001]), (9008, [None, 1.0]), (0, x[0].tolist())]
    df = df.unionByName(spark.createDataFrame(odd, "vec_id bigint, embedding array<float>"), allowMissingColumns=True)
    want = dict(enumerate(linked_vectors(x))) | {i: (i, 0) for i in (9000, 9001, 9002, 9003, 9004, 9008)} | {i: (9005, 2) for i in (9005, 9006, 9007)}
    got = pq.links(df).collect()
    assert {r.vec_id: (r.class_id, r.n_links) for r in got} == want and len(got) == len(want)
    if not small:
        assert pq.links(df.limit(0)).count() == 0
        doubles = pq.links(df.withColumn("embedding", F.col("embedding").cast("array<double>"))).collect()
        assert sorted(doubles) == sorted(got)


def test_vector_links_recall(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(6000, 64))
    near = np.repeat(base[:300], 5, axis=0) + r.normal(size=(1500, 64)) * r.choice([0.1, 0.3, 0.4, 0.45], 1500)[:, None]
    x = np.concatenate([base, near]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {v.vec_id: v.n_links for v in pq.links(df).collect()}
    want = linked_vectors(x)
    assert all(got[i] <= n for i, (_, n) in enumerate(want))
    recall = sum(got.values()) / sum(n for _, n in want)
    print("recall", recall)
    assert recall >= 0.98
