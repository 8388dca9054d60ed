import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chunking


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()[0]


def test_uuid5_is_pythons(spark):
    name = "k/é漢"
    assert one(spark, T.entity_uuid(F.lit("g"), F.col("k")), k=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{T.ID_PREFIX}/entity/g/{name}"))


def test_tokens_and_truncation(spark):
    assert one(spark, T.token_count(F.col("t")), t="a" * 9) == 3
    assert one(spark, T.token_count(F.col("t")), t=None) == 0
    assert one(spark, T.truncate(F.col("t"), 2), t="abcdefghij") == "abcdefgh"
    with pytest.raises(ValueError):
        T.truncate(F.col("t"), -1)


def test_document_id(spark):
    assert one(spark, T.document_id(F.col("t"), F.col("s")), t="x", s=" My Source! ") == "doc:my-source"
    assert one(spark, T.document_id(F.col("t"), F.col("s")), t="x", s="--") == one(spark, T.document_id(F.col("t")), t="x")


def test_normalize_name(spark):
    for a, b in (("Microsoft Corp.", "Microsoft Corporation"), ("Open AI", "OpenAI"), ("ACME, Inc.", "acme holdings")):
        assert one(spark, T.normalize_name(F.col("a")), a=a) == one(spark, T.normalize_name(F.col("a")), a=b)
    assert one(spark, T.normalize_name(F.col("a")), a=None) == ""
    wide = unicodedata.normalize("NFD", "Straße é")
    assert one(spark, T.normalize_name(F.col("a"), True), a=wide) == "strasseé"


def test_lexical_query(spark):
    assert one(spark, T.lexical_query(F.col("q")), q='the "big red" dog the') == '"big red" OR "the" OR "dog"'
    assert one(spark, T.lexical_query(F.col("q")), q="?!") == '"?!"'


def test_indel_ratio(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
        return row[-1]

    pairs = [("johnsmith", "jonsmith"), ("", ""), ("a", ""), ("abc", "abd"), ("kitten", "sitting"), ("ab" * 30, "ba" * 31), (None, "x")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.indel_ratio("a", "b").alias("s")).collect()
    for r in got:
        a, b = r.a or "", r.b or ""
        assert r.s == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)


def test_character_chunks(spark):
    text = "abcdefghijklmnopqrstuvwxyz"
    rows = spark.createDataFrame([("doc1", text), ("e", ""), ("n", None), ("b", "x" + " " * 20 + "y")], "document_id string, text string")
    got = {r.chunk_id: r for r in chunking.chunk_chars(rows, 10, 2).collect()}
    assert [got[f"doc1:chunk:{i}"].text for i in range(3)] == [text[0:10], text[8:18], text[16:26]]
    assert (got["doc1:chunk:0"].char_start, got["doc1:chunk:0"].char_end) == (0, 10)
    assert not any(k.startswith(("e:", "n:")) for k in got)
    assert "b:chunk:1" not in got and "b:chunk:2" in got  # a blank chunk keeps its index
    with pytest.raises(ValueError):
        chunking.chunk_chars(rows, 10, 10)


def test_token_chunks(spark):
    rows = spark.createDataFrame([("d", "a" * 40), ("b", "x" * 16 + " " * 40 + "y")], "document_id string, text string")
    got = {r.chunk_id: r for r in chunking.chunk_tokens(rows, 5, 1).collect()}
    assert (got["d:chunk:0"].char_start, got["d:chunk:0"].char_end, got["d:chunk:0"].token_end) == (0, 20, 5)
    assert (got["d:chunk:1"].char_start, got["d:chunk:1"].token_start) == (16, 4)
    assert [k for k in got if k.startswith("b:")] == ["b:chunk:0"]  # the first blank chunk ends it


class FourChars:
    def count(self, text):
        return -(-len(text) // 4)

    def truncate(self, text, n):
        return text[: 4 * n]


def test_exact_chunks_equal_approximate_ones(spark):
    rows = spark.createDataFrame([("d", "abcdefgh" * 13)], "document_id string, text string")
    a = chunking.chunk_exact(rows, FourChars(), 5, 1).select("chunk_id", "text", "char_start", "token_start", "token_end").collect()
    b = chunking.chunk_tokens(rows, 5, 1).select("chunk_id", "text", "char_start", "token_start", "token_end").collect()
    assert sorted(a) == sorted(b)


def test_page_windows(spark):
    pages = spark.createDataFrame([("doc1", i, f"p{i}", f"page-{i}", "movies") for i in (3, 1, 4, 2)], "document_id string, page int, text string, record string, collection string")
    got = sorted(chunking.page_windows(pages, 2, 1, record="record", collection="collection").collect())
    assert [r.chunk_id for r in got] == ["doc1:pages:1-2", "doc1:pages:2-3", "doc1:pages:3-4"]
    assert got[0].text == "p1\n\np2" and got[0].record_ids == ["page-1", "page-2"] and got[0].collections == ["movies"]
