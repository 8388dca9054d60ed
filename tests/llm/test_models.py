"""Language identification, the quality network and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import langid, mixing, quality, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def model(corpus):
    return langid.train(corpus)


def test_trigrams_cover_long_texts():
    text = "Ab1 çd, " * 300_000
    a = np.concatenate([h for _, h in langid.trigrams([text])])
    one = np.bincount(langid._bins(" " + text.lower() + " ")[1], minlength=langid.BINS)
    assert np.array_equal(np.bincount(a, minlength=langid.BINS), one)
    both = {k: [] for k in range(4)}
    for t, h in langid.trigrams(["abc", None, "", "x"]):
        for k in range(4):
            both[k] += h[t == k].tolist()
    assert [len(both[k]) for k in range(4)] == [3, 0, 0, 1]


def test_held_out_languages(spark, corpus, model):
    other = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(corpus.select("doc_id"), "doc_id", "left_anti")
    got = langid.identify(other, model).join(other.select("doc_id", "lang"), "doc_id")
    right, n, kept = got.agg(F.count_if(F.col("language") == F.col("lang")), F.count("*"), F.count_if("accepted")).first()
    assert right / n >= 0.98 and kept / n >= 0.99


def by_hand(model, rows):
    """The posterior of each row, in plain Python."""
    k = len(model.languages)
    ll, letters = model.score([r[1] for r in rows])
    host = [(r[2] or "").lower().split("//")[-1].split("/")[0].split(":")[0] for r in rows]
    domain = [".".join(h.split(".")[-2:]) for h in host]
    suffix = [h.rsplit(".", 1)[1] if "." in h else None for h in host]
    declared = [r[3] if r[3] in (None, *model.languages[:-1]) else "other" for r in rows]
    p = np.exp(ll - ll.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    own = [int(x.argmax()) if n and x.max() >= langid.CONFIDENT else None for x, n in zip(p, letters, strict=True)]

    def count(values, v):
        return np.bincount([o for o, x in zip(own, values, strict=True) if o is not None and x == v], minlength=k).astype(float)

    everyone = count([1] * len(rows), 1) + 1
    everyone /= everyone.sum()
    out = []
    for i in range(len(rows)):
        if not letters[i]:
            out.append(("und", 0.0))
            continue
        mine = np.eye(k)[own[i]] if own[i] is not None else np.zeros(k)
        d = np.maximum(0, count(domain, domain[i]) - mine) if host[i] else np.zeros(k)
        n = np.maximum(0, count(host, host[i]) - mine) if host[i] else np.zeros(k)
        prior = (n + langid.WEIGHT * (d + langid.WEIGHT * everyone) / (d.sum() + langid.WEIGHT)) / (n.sum() + langid.WEIGHT)
        s = ll[i] + np.log(prior)
        for values, size in ((suffix, len({x for x in suffix if x})), (declared, k + 1)):
            if values[i] is not None:
                total = sum(count(values, v) for v in {x for x in values if x is not None})
                s += np.log((np.maximum(0, count(values, values[i]) - mine) + 1) / (total + size - mine))
        q = np.exp(s - s.max())
        out.append((model.languages[int(q.argmax())], float(q.max() / q.sum())))
    return out


def test_fusion_is_what_it_says(spark, corpus, model):
    texts = [r.text for r in corpus.orderBy("doc_id").limit(40).collect()]
    hosts = ["http://a.site.fr/x", "https://b.site.fr/", "http://c.de:80/y", None, "src0", ""]
    declared = [None, "fr", "de", "xx"]
    rows = [(i, t[: 5 + 40 * (i % 4)], hosts[i % 6], declared[i % 4]) for i, t in enumerate(texts)] + [(90, None, "http://c.de", "de"), (91, "12 !!", None, None), (None, "the", None, None), (92, "的漢字" * 30, "", None)]
    html = lambda d: None if d is None else f"<html class=x lang='{d}-XX'>"
    df = spark.createDataFrame([(*r[:3], html(r[3])) for r in rows], "doc_id bigint, text string, source string, m string")
    got = {r.doc_id: (r.language, r.probability, r.accepted) for r in langid.identify(df, model, markup="m").collect()}
    for r, (language, p) in zip(rows, by_hand(model, rows), strict=True):
        assert got[r[0]][0] == language and got[r[0]][1] == pytest.approx(p, abs=1e-6)
        assert got[r[0]][2] == (language != "und" and p >= langid.ACCEPT)
    assert got[92][0] == "und" and got[90] == ("und", 0.0, False)


def test_rejected_documents_go(spark, corpus, model):
    df = corpus.limit(30).withColumns({"_ID": F.lit(1), "_key": F.lit(2)})
    odd = df.limit(3).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.lit(None).cast("string")))
    kept = langid.keep(df.unionByName(odd), model)
    assert kept.columns == df.columns and sorted(kept.collect()) == sorted(df.collect())
    assert langid.keep(df.limit(0), model).count() == 0 and langid.keep(df.limit(0)).count() == 0


def test_pages(spark, corpus):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = langid.of_pages(pages, corpus)
    assert got.count() == pages.count() and got.filter("accepted").count() >= 0.95 * pages.count()


def test_gradients_are_right():
    r = np.random.default_rng(0)
    net = quality.Network()
    for p in net.parts():
        p += r.normal(0, 0.3, p.shape).astype(np.float32)
    raws = [quality.padded("".join(chr(c) for c in r.integers(32, 120, n))) for n in (10, 700, 2500)]
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        total = 0.0
        for p, label in zip(raws, y, strict=True):
            q = net.probability(net.features(net.cells(np.concatenate([p, np.zeros(quality.WIDTH - quality.STRIDE, np.uint8)]))))
            total -= np.log(q if label else 1 - q)
        return total / 3

    g = net.gradients(raws, y)
    for part, grad in zip(net.parts(), g, strict=True):
        flat, e = part.reshape(-1), 1e-2
        for i in np.argsort(-np.abs(grad.reshape(-1)))[:3]:
            keep = flat[i]
            flat[i] = keep + e
            up = loss()
            flat[i] = keep - e
            down = loss()
            flat[i] = keep
            assert (up - down) / 2 / e == pytest.approx(grad.reshape(-1)[i], rel=0.25, abs=2e-3)


def test_scores_don_t_depend_on_the_batch(monkeypatch):
    net = quality.Network()
    texts = ["", None, "short", "long text é " * 400, "x" * 5000]
    alone = [net.score([t])[0] for t in texts]
    assert net.score(texts) == pytest.approx(alone)
    assert alone[1] is None
    monkeypatch.setattr(quality, "TURN", 2048)
    assert net.score(texts) == pytest.approx(alone, abs=1e-6)


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter("doc_id % 4 = 0")
    net = quality.train(docs, labels.join(held, "doc_id", "left_anti"))
    x = quality.score(docs.join(held, "doc_id", "left_semi"), net).join(held.groupBy("doc_id").agg(F.min("quality").alias("y")), "doc_id").collect()
    assert np.mean([(r.quality >= 0.5) == r.y for r in x]) >= 0.9
    odd = spark.createDataFrame([(None, "a"), (1, None), (1, "b"), (1, "b")], "doc_id bigint, text string")
    assert quality.score(odd, net).count() == 4
    none = quality.train(docs.limit(0), labels)
    assert {r.quality for r in quality.score(odd, none).collect()} == {0.5, None}


def test_pipeline_mixing_keeps_all(spark, corpus):
    skewed = corpus.withColumn("source", F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("rare"), "doc_id")).when(F.col("doc_id") % 2 == 0, F.lit("hot")).otherwise(F.col("source")))
    mixed = corpus_pipeline.source_mixing(spark, skewed, SF)
    assert mixed.columns == [*skewed.columns, "mixture_slot"]
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in skewed.collect())


def test_pipeline_mixing_is_the_schedule_of_op8(spark, corpus):
    ends = {(r.doc_id, r.slot) for r in mixing.mix(corpus).collect()}
    whole = {(r.doc_id, r.mixture_slot) for r in corpus_pipeline.source_mixing(spark, corpus, SF).collect()}
    assert ends == {x for x in whole if x[1] <= max(s for _, s in ends)} and len(ends) < len(whole)


def test_pipeline_against_brute_force(spark, corpus):
    from tests.llm.test_join import brute, grams

    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    kept = {r.doc_id for r in langid.of_documents(corpus).filter("accepted").collect()}
    rows = [(i, t) for i, t in rows if i in kept]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in brute(rows):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    first = {i for i in root if find(i) == i}
    assert set(out) <= first
    stage = spark.createDataFrame([(i, t) for i, t in rows if i in first], "doc_id bigint, text string")
    full = corpus.join(stage.select("doc_id"), "doc_id", "left_semi")
    clean = corpus_pipeline.decontamination(spark, full, SF)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {i for i, t in rows if any(grams(x, 8) <= grams(t, 8) for x in items if len(grams(x, 8)) > 1)}
    left = {r.doc_id for r in clean.collect()}
    assert not left & exact and len(left) > 0.8 * len(first)
    mixed = corpus_pipeline.source_mixing(spark, clean, SF)
    assert set(out) == {r.doc_id for r in mixed.collect()}
    table = sharding.fill(sharding.shard_names(sharding.SHARDS), sharding.TABLE_SIZE)
    assert all(r.shard == table[r.slot] for r in out.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "source_mixing", "sharding"]
