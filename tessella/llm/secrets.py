r"""Secret scan: keyword prefilter, anchored patterns near its hits, embedded checksums.

One Aho-Corasick pass over a text finds the keywords of all rules. Only at a hit a rule's pattern is tried, anchored
where the keyword begins. Formats that embed a checksum (base62 CRC-32, base58check, bech32) or a parsable header
(JSON web tokens) have it validated; what fails is no secret. The secret itself is not given out: a row holds its
place, SHA-256 and first characters.

A map over the scan without any shuffle.

Defined cases: null and empty texts have no rows; repeated documents give repeated rows; a null id stays null; where
two rules match at one place both are reported; texts of any length are scanned whole; an empty table gives an empty result.
Other columns are ignored, also ones named like those of the result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import col, ship

SCHEMA = "doc_id bigint, rule string, start_char int, end_char int, secret_start int, secret_sha256 string, masked string, checksum string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("rule", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("secret_start", pa.int32()), ("secret_sha256", pa.string()), ("masked", pa.string()), ("checksum", pa.string())])
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def crc_base62(secret: str) -> bool:
    """prefix_ + 30 characters + their CRC-32 as 6 base62 digits."""
    body = secret[secret.index("_") + 1 :]
    crc, digits = zlib.crc32(body[:30].encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = BASE62[d] + digits
    return body[30:] == digits


def base58check(secret: str) -> bool:
    """The last 4 of the decoded bytes begin the double SHA-256 of the others."""
    v = 0
    for c in secret:
        v = v * 58 + BASE58.index(c)
    raw = v.to_bytes(82, "big") if v.bit_length() <= 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32(secret: str) -> bool:
    """Polynomial checksum over the part before the last 1 and the data after it."""
    s = secret.lower()
    human, _, data = s.rpartition("1")
    values = [ord(c) >> 5 for c in human] + [0] + [ord(c) & 31 for c in human] + [BECH32.index(c) for c in data]
    chk = 1
    for v in values:
        top, chk = chk >> 25, (chk & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            chk ^= g if top >> i & 1 else 0
    return chk == 1


def jwt_header(secret: str) -> bool:
    """The first part is base64url of a JSON object that names an algorithm."""
    head = secret.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


class Rule(NamedTuple):
    name: str
    keywords: tuple[str, ...]  # in lower case
    pattern: str  # anchored at a keyword; group 1 is the secret
    check: Callable[[str], bool] | None = None


_END = r"(?![A-Za-z0-9_])"
_BEGIN = r"(?<![A-Za-z0-9_])"
#: After a keyword: the rest of the name, the name's closing quote, a sign of assignment and the value.
_VALUE = r"""(?i:(?:[_-](?:key|id))?)["']?(?:\s{0,3}|[ \t]*)(?::=|=>|[=:])(?:\s{0,3}|[ \t]*)["']?([A-Za-z0-9+/=_.~!@#$%^&*-]{8,})["']?"""
RULES = [
    Rule("aws_access_key", ("akia", "asia", "abia", "acca"), rf"{_BEGIN}((?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{{16}}){_END}"),
    Rule("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), rf"{_BEGIN}(gh[pousr]_[A-Za-z0-9]{{36}}){_END}", crc_base62),
    Rule("github_fine_grained", ("github_pat_",), rf"{_BEGIN}(github_pat_[A-Za-z0-9]{{22}}_[A-Za-z0-9]{{59}}){_END}"),
    Rule("npm_token", ("npm_",), rf"{_BEGIN}(npm_[A-Za-z0-9]{{36}}){_END}", crc_base62),
    Rule("gitlab_token", ("glpat-",), rf"{_BEGIN}(glpat-[A-Za-z0-9_-]{{20}}){_END}"),
    Rule("slack_token", ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"), rf"{_BEGIN}(xox[baprs]-[A-Za-z0-9-]{{10,}}){_END}"),
    Rule("stripe_key", ("sk_live_", "rk_live_"), rf"{_BEGIN}([sr]k_live_[A-Za-z0-9]{{16,}}){_END}"),
    Rule("google_api_key", ("aiza",), rf"{_BEGIN}(AIza[A-Za-z0-9_-]{{35}}){_END}"),
    Rule("pypi_token", ("pypi-",), rf"{_BEGIN}(pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{{50,}}){_END}"),
    Rule("sendgrid_key", ("sg.",), rf"{_BEGIN}(SG\.[A-Za-z0-9_-]{{22}}\.[A-Za-z0-9_-]{{43}}){_END}"),
    Rule("json_web_token", ("eyj",), rf"{_BEGIN}(eyJ[A-Za-z0-9_-]{{8,}}\.eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}){_END}", jwt_header),
    Rule("private_key", ("-----begin ",), r"(-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----)"),
    Rule("wallet_private_key", ("xprv",), rf"{_BEGIN}(xprv[1-9A-HJ-NP-Za-km-z]{{107}}){_END}", base58check),
    Rule("age_secret_key", ("age-secret-key-1",), rf"{_BEGIN}(AGE-SECRET-KEY-1[QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{{58}}){_END}", bech32),
    Rule("password_assignment", ("password", "passwd", "pwd"), rf"(?i:(?:password|passwd|pwd)){_VALUE}"),
    Rule("token_assignment", ("token", "secret", "api_key", "apikey", "api-key", "access_key"), rf"(?i:(?:access_token|token|secret|api[_-]?key|access_key)){_VALUE.replace('{8,}', '{16,}')}"),
]


@cache
def _machine():
    import ahocorasick

    found = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for k, r in enumerate(RULES):
        for w in r.keywords:
            by.setdefault(w, []).append(k)
    for w, ks in by.items():
        found.add_word(w, (len(w), tuple(ks)))
    found.make_automaton()
    return found, [re.compile(r.pattern) for r in RULES]


def lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def scan(text: str) -> list[tuple[str, int, int, int, str]]:
    """(rule, start, end, start of the secret, secret), by place."""
    found, patterns = _machine()
    out = {}
    for last, (n, ks) in found.iter(lower(text)):
        at = last + 1 - n
        for k in ks:
            m = patterns[k].match(text, at)
            if m and (RULES[k].check is None or RULES[k].check(m[1])):
                out[at, k] = (RULES[k].name, m.start(), m.end(), m.start(1), m[1])
    return [out[x] for x in sorted(out)]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    checked = {r.name: "valid" if r.check else "none" for r in RULES}
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for rule, a, b, s, secret in scan(text) if text else ():
                rows.append((doc, rule, a, b, s, hashlib.sha256(secret.encode("utf-8", "surrogatepass")).hexdigest(), secret[:4] + "*" * 8, checked[rule]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def find(docs: DataFrame) -> DataFrame:
    """A row for each secret of each document: see SCHEMA; characters from 0."""
    ship(docs.sparkSession)
    return docs.select(col("doc_id").cast("bigint").alias("doc_id"), col("text").alias("text")).mapInArrow(_run, SCHEMA)
