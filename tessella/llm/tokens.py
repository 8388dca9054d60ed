"""Token ids in directly addressable codes.

An id is split into chunks of WIDTH bits, lowest first. Level k holds the k-th chunk of every id that has one, and a
bitmap that says which ids go on to level k + 1. A rank directory over the bitmap (set bits before each 512) tells in
constant time where an id's next chunk is, so any token is read without decoding others.

Layout, little-endian: u32 tokens, u8 width, u8 levels, u16 0; per level u32 count, the chunks, and on all levels
but the last the bitmap in 64-bit words and the directory in u32.

Texts are tokenised by byte-pair ranks of a public vocabulary file, whose path is a parameter; a map over the scan. Where
workers are on other machines than the driver, Spark hands them the file.

Defined cases: a null text gives null tokens and codes; an empty one 0 tokens and codes without levels; repeated rows
give repeated rows, null ids stay null; a text of any length is tokenised whole; an empty table gives an empty result. Other
columns are ignored, also ones named `codes` or `n_tokens`.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import col, ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WIDTH = 8
#: Longer texts go to the tokenizer in pieces, cut before a space that begins a word: no token spans such a place.
PIECE = 1 << 20
_TYPE = {8: np.dtype("<u1"), 16: np.dtype("<u2")}


def encode(ids: np.ndarray, width: int = WIDTH) -> bytes:
    rest = np.asarray(ids, np.uint32)
    levels = []
    while len(rest):
        levels.append(np.uint32(len(rest)).tobytes() + (rest & ((1 << width) - 1)).astype(_TYPE[width]).tobytes())
        more = rest >= (1 << width)
        rest = rest[more] >> width
        if len(rest):
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)]).view("<u8")
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.uint32)])[:-1:8]
            levels[-1] += bits.tobytes() + ones.astype("<u4").tobytes()
    return struct.pack("<IBBH", len(ids), width, len(levels), 0) + b"".join(levels)


class Codes:
    """Random access to the ids in encoded bytes; only the bytes that a read needs are looked at."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self.n, self.width, self.levels, _ = struct.unpack_from("<IBBH", raw)
        self.at, p = [], 8
        for k in range(self.levels):
            (count,) = struct.unpack_from("<I", raw, p)
            chunks = p + 4
            bitmap = chunks + count * self.width // 8
            words = -(-count // 64) if k + 1 < self.levels else 0
            self.at.append((count, chunks, bitmap, bitmap + words * 8))
            p = bitmap + words * 8 + -(-words // 8) * 4

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        i = int(i)
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (_, chunks, bitmap, directory) in enumerate(self.at):
            size = self.width // 8
            value |= int.from_bytes(self.raw[chunks + i * size : chunks + (i + 1) * size], "little") << (k * self.width)
            if k + 1 == self.levels:
                break
            w = i // 64
            (word,) = struct.unpack_from("<Q", self.raw, bitmap + w * 8)
            if not word >> (i % 64) & 1:
                break
            (before,) = struct.unpack_from("<I", self.raw, directory + w // 8 * 4)
            for x in range(w // 8 * 8, w):
                before += struct.unpack_from("<Q", self.raw, bitmap + x * 8)[0].bit_count()
            i = before + (word & ((1 << (i % 64)) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(self.n, np.uint32)
        place = np.arange(self.n)
        for k, (count, chunks, bitmap, directory) in enumerate(self.at):
            out[place] |= np.frombuffer(self.raw, _TYPE[self.width], count, chunks).astype(np.uint32) << np.uint32(k * self.width)
            if k + 1 < self.levels:
                place = place[np.unpackbits(np.frombuffer(self.raw, np.uint8, directory - bitmap, bitmap), bitorder="little", count=count).astype(bool)]
        return out


@lru_cache(2)
def tokenizer(path: str):
    import tiktoken

    with open(path) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_CUT = re.compile(r"(?<=\S) (?=[^\W\d_])")


def tokenize(text: str, path: str = VOCABULARY) -> np.ndarray:
    enc = tokenizer(path)
    if len(text) <= PIECE:
        return enc.encode_to_numpy(text, disallowed_special=())
    out, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + PIECE)
        end = m.start() if m else len(text)
        out.append(enc.encode_to_numpy(text[at:end], disallowed_special=()))
        at = end
    return np.concatenate(out)


def token_table(docs: DataFrame, path: str = VOCABULARY, width: int = WIDTH) -> DataFrame:
    """doc_id, n_tokens INT, codes BINARY of each document."""
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    sent = not sc.master.startswith("local[")
    if sent:
        sc.addFile(path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = SparkFiles.get(os.path.basename(path)) if sent else path
        for batch in batches:
            n, codes = [], []
            for t in batch.column(1):
                ids = None if (s := t.as_py()) is None else tokenize(s, at)
                n.append(None if ids is None else len(ids))
                codes.append(None if ids is None else encode(ids, width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(codes, pa.binary())], schema=schema)

    rows = docs.select(col("doc_id").cast("bigint").alias("doc_id"), col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens int, codes binary")


def token_at(codes: Column, index: Column) -> Column:
    """The id at a place, from 0; null where there is none."""

    @F.arrow_udf("bigint")
    def at(raw: pa.Array, i: pa.Array) -> pa.Array:
        out = []
        for r, k in zip(raw, i, strict=True):
            r, k = r.as_py(), k.as_py()
            c = Codes(r) if r is not None and k is not None else ()
            out.append(c[k] if k is not None and 0 <= k < len(c) else None)
        return pa.array(out, pa.int64())

    return at(codes, index)
