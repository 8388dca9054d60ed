"""Sharding, mixing, tokens, secrets, WARC: small cases against what they should give."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing, secrets, sharding, tokens, warc

DOCS = "doc_id bigint, text string, source string, slot string, Shard string, _key int"


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_table_is_fair_and_keeps_places():
    names = sharding.shard_names(16)
    table = sharding.fill(names, 2039)
    n = Counter(table.tolist())
    assert len(n) == 16 and max(n.values()) - min(n.values()) <= 1
    fewer = sharding.fill(names[:-1], 2039)
    kept = table != 15
    assert (table[kept] == fewer[kept]).mean() > 0.8
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (list("abcdefgh"), 7)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_sharding_of_odd_rows(spark):
    rows = docs(spark, [(None, None, None, "s", "t", 1), (1, "", "a", "s", "t", 1), (1, "x" * 10**6, "a", "s", "t", 1)])
    got = sharding.assign(rows).collect()
    assert len(got) == 3 and len({r.shard for r in got if r.doc_id == 1}) == 1
    assert got[0].asDict().keys() == {"doc_id", "text", "source", "_key", "slot", "shard"}
    assert sharding.assign(rows.limit(0)).count() == 0
    h = int(hashlib.md5(b"1").hexdigest()[:8], 16) % sharding.TABLE_SIZE
    table = sharding.fill(sharding.shard_names(sharding.SHARDS), sharding.TABLE_SIZE)
    assert {(r.slot, r.shard) for r in got if r.doc_id == 1} == {(h, int(table[h]))}


def test_mixing_follows_weights(spark):
    r = random.Random(4)
    rows = [(i, "x" * r.randrange(1, 400), r.choice(["a", "b", None]), "s", "t", 1) for i in range(900)]
    rows += [(None, None, "a", "s", "t", 1), (5, "", "b", "s", "t", 1)]
    got = mixing.mix(docs(spark, rows), {"a": 2, "b": 1, "zz": 5}, block_tokens=500).collect()
    by = Counter()
    for x in got:
        by[x.source] += max(1, -(-len(x.text or "") // 4))
    assert set(by) == {"a", "b"}
    assert by["a"] / by["b"] == pytest.approx(2, rel=0.3)
    assert len({(x.source, x.block, x.slot) for x in got}) == len({x.slot for x in got}) == len({(x.source, x.block) for x in got})
    assert mixing.mix(docs(spark, rows).limit(0)).count() == 0
    plain = mixing.mix(docs(spark, rows), block_tokens=500)
    assert plain.columns == ["doc_id", "text", "source", "Shard", "_key", "block", "slot"]
    again = mixing.mix(docs(spark, rows[::-1]).repartition(7), block_tokens=500)
    key = lambda x: (str(x.doc_id), str(x.text), x.slot)
    assert sorted(map(key, plain.collect())) == sorted(map(key, again.collect()))


def test_mixing_to_the_end_keeps_all(spark):
    r = random.Random(6)
    sizes = {"hot": 3000, "rare": 12, None: 300, **{f"s{i}": 200 for i in range(5)}, **{f"one{i}": 1 for i in range(20)}}
    rows = [(k, "x" * r.randrange(1, 400), s, "s", "t", 1) for k, s in enumerate([s for s, n in sizes.items() for _ in range(n)])]
    rows += [(None, None, "hot", "s", "t", 1), (5, "", "rare", "s", "t", 1)]
    df = docs(spark, rows)
    got = mixing.mix(df, block_tokens=500, exhaust=True).collect()
    plain = lambda x: (str(x.doc_id), str(x.text), str(x.source))
    assert sorted(map(plain, got)) == sorted((str(a), str(b), str(c)) for a, b, c, *_ in rows)
    at = {(x.source, x.block): x.slot for x in got}
    assert len(set(at.values())) == len(at) == len({(x.source, x.block, x.slot) for x in got})
    # A source's blocks come in order, and while sources last any stretch has their weights.
    assert all(at[s, b] < at[s, b + 1] for s, b in at if (s, b + 1) in at)
    tokens_of = Counter()
    for x in got:
        tokens_of[x.source] += max(1, -(-len(x.text or "") // 4))
    last = min(max(v for (s, _), v in at.items() if s == f"s{i}") for i in range(5))
    n = Counter(s for (s, _), v in at.items() if v < last)
    assert n["hot"] / n["s0"] == pytest.approx((tokens_of["hot"] / tokens_of["s0"]) ** mixing.TEMPERATURE, rel=0.2)
    again = mixing.mix(docs(spark, rows[::-1]).repartition(7), block_tokens=500, exhaust=True).collect()
    key = lambda x: (*plain(x), x.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))
    given = mixing.mix(df, {"hot": 1, "rare": 1e-12, "s0": 0, "zz": 3}, block_tokens=500, exhaust=True).collect()
    assert Counter(x.source for x in given) == {"hot": 3001, "rare": 13}
    assert mixing.mix(df.limit(0), exhaust=True).count() == 0


def golden(weights, blocks):
    """The schedule of all blocks, point by point, as (source, block) in order; the number of stretches."""
    out, done, start, stretches = [], Counter(), 0, 0
    while left := sorted(s for s in blocks if done[s] < blocks[s]):
        total, n = sum(weights[s] for s in left), sum(blocks[s] - done[s] for s in left)
        length = max(n + 1, int(min(mixing.STRETCH * n, max((blocks[s] - done[s] + mixing.LAG) / weights[s] for s in left) * total)))
        ends = [int(round(sum(weights[x] for x in left[: i + 1]) / total, 9) * 2**32) for i in range(len(left))]
        for t in range(start, start + length):
            s = left[next(i for i, e in enumerate(ends) if t * mixing.GOLDEN % 2**32 < e)]
            if done[s] < blocks[s]:
                out.append((s, done[s]))
                done[s] += 1
        start, stretches = start + length, stretches + 1
    return out, stretches


def test_mixing_to_the_end_follows_the_golden_ratio(spark):
    r = random.Random(8)
    sizes = {"a": 900, "b": 500, "c": 60, None: 240}
    rows = [(k, "x" * r.randrange(1, 400), s, "s", "t", 1) for k, s in enumerate([s for s, n in sizes.items() for _ in range(n)])]
    df, key = docs(spark, rows), lambda x: (x.doc_id, x.slot, x.block)
    # Up to where the first source runs out it is the mixture that ends there.
    whole, ends = ({key(x) for x in mixing.mix(df, block_tokens=500, exhaust=e).collect()} for e in (True, False))
    assert 0 < len(ends) < len(whole) == len(rows)
    assert {x for x in whole if x[1] <= max(s for _, s, _ in ends)} == ends
    for weights, blocks in [
        ({"": 5.0, "a": 3.0, "b": 1.0}, {"": 3, "a": 90, "b": 70}),
        ({"a": 1e-12, "b": 7.0, "c": 1e-13, "d": 2.0}, {"a": 40, "b": 300, "c": 9, "d": 5}),
        ({"a": 1.0}, {"a": 5}),
    ]:
        sources = spark.createDataFrame([(s, weights[s], blocks[s]) for s in blocks], "skey string, weight double, blocks bigint")
        got = mixing.whole_schedule(sources).orderBy("slot").collect()
        expected, stretches = golden(weights, blocks)
        assert [x.slot for x in got] == list(range(sum(blocks.values())))
        assert [(x.skey, x.block) for x in got] == expected and (stretches > 1) == (1e-12 in weights.values())
    # Points far out, where a product with the multiplier no longer fits.
    far = mixing.schedule(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "skey string, weight double"), 50, 2**32 - 20).collect()
    third = int(round(1 / 3, 9) * 2**32)
    assert {x.slot: x.skey for x in far} == {t: "a" if t * mixing.GOLDEN % 2**32 < third else "b" for t in range(2**32 - 20, 2**32 + 30)}


def test_codes_give_any_token():
    r = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 511, 513, 5000):
        for top in (2, 300, 70_000, 2**32 - 1):
            ids = r.integers(0, top, n, dtype=np.uint64, endpoint=True).astype(np.uint32)
            for width in (8, 16):
                c = tokens.Codes(tokens.encode(ids, width))
                assert len(c) == n and np.array_equal(c.all(), ids)
                assert all(c[i] == ids[i] for i in r.integers(0, n, min(n, 40)))
    with pytest.raises(IndexError):
        tokens.Codes(tokens.encode(np.array([1])))[1]


def test_token_table(spark):
    long = "Hello there, world 42! " * 60_000
    got = {x.doc_id: x for x in tokens.token_table(docs(spark, [(1, "Hello world", "a", "", "", 1), (2, None, "a", "", "", 1), (3, "", "a", "", "", 1), (4, long, "a", "", "", 1)])).collect()}
    enc = tokens.tokenizer(tokens.VOCABULARY)
    assert enc.decode(tokens.Codes(got[1].codes).all().tolist()) == "Hello world"
    assert got[2].codes is None and got[2].n_tokens is None and got[3].n_tokens == 0
    assert tokens.Codes(got[4].codes).all().tolist() == enc.encode(long)
    t = tokens.token_table(docs(spark, [(1, "Hello world", "a", "", "", 1)]))
    assert [x.t for x in t.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(9)))).select(tokens.token_at(F.col("codes"), F.col("i")).alias("t")).collect()] == [*enc.encode("Hello world"), None]


def github(body):
    crc, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = secrets.BASE62[d] + digits
    return f"ghp_{body}{digits}"


def test_secrets(spark):
    good = github("a1B2" * 7 + "zz")
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    text = f"İ x {good} y {bad} AKIA{'Q' * 16} password = 'hunter2hunter2' -----BEGIN RSA PRIVATE KEY-----"
    found = secrets.scan(text)
    assert [f[0] for f in found] == ["github_token", "aws_access_key", "password_assignment", "private_key"]
    assert all(text[s : s + len(x)] == x for _, _, _, s, x in found)
    got = secrets.find(docs(spark, [(1, text, "", "", "", 1), (1, text, "", "", "", 1), (None, good, "", "", "", 1), (2, None, "", "", "", 1), (3, "", "", "", "", 1), (4, "x " * 500_000 + good, "", "", "", 1)])).collect()
    n = Counter(r.doc_id for r in got)
    assert n == {1: 8, None: 1, 4: 1}
    assert all(good not in str(r) for r in got)
    import re

    brute = {(m.start(), r.name) for r in secrets.RULES for m in re.finditer(r.pattern, text) if r.check is None or r.check(m[1])}
    assert brute == {(f[1], f[0]) for f in found}


@pytest.mark.parametrize(
    "text",
    [
        '{"password": "hunter2hunter2"}', '{"api_key": "abcdefabcdef0123456789"}', "DB_PASSWORD=hunter2hunter2", "secret_key = abcdefabcdef0123456789",
        "SECRET_KEY='abcdefabcdef0123456789'", "db.password: hunter2hunter2", "aws_access_key_id=abcdefabcdef0123456789", "password:        hunter2hunter2",
        "'token' => 'abcdefabcdef0123456789'", 'password := "hunter2hunter2"', 'token = "abcdefabcdef0123456789"',
    ],
)
def test_assigned_secrets(text):
    assert [x[4] for x in secrets.scan(text)] == ["hunter2hunter2" if "hunter2" in text else "abcdefabcdef0123456789"]


def test_no_secret_without_a_value():
    for text in ("password", "the password is: short", "secret_keys = abcdefabcdef0123456789", "passwords and tokens: none"):
        assert not secrets.scan(text)


def test_warc(spark):
    html = '<!DOCTYPE html><html lang="FR"><head><title>T &amp;\n x</title></head><body><nav>no</nav><p>A&#233;&lt;b</p><!-- c --><a href="/u">L</a><script >var t="</p>";</script></body></html>'
    rows = warc.derive(spark.createDataFrame([(1, "http://a/", html), (2, None, None), (1, "http://a/", html)], "page_id bigint, url string, html string"))
    got = rows.collect()
    assert len(got) == 6
    text = next(r for r in got if r.page_id == 1 and r.record_type == "conversion")
    assert text.block == "Aé<b\nL" and text.block_digest == "sha256:" + hashlib.sha256(text.block.encode()).hexdigest()
    meta = next(r for r in got if r.page_id == 1 and r.record_type == "metadata")
    assert "outlink: /u\r\n" in meta.block and "language: fr" in meta.block and meta.refers_to == text.refers_to != meta.record_id
    assert hashlib.sha256(html.encode()).hexdigest() in meta.source_headers
    assert next(r for r in got if r.page_id == 2 and r.record_type == "conversion").block == ""
