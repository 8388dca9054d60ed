r"""Derivatives of web responses: linked WARC metadata and plain-text conversion records.

Each page becomes the identity of a response record and two records that refer to it. All identifiers are name-based
(urn:uuid made of the MD5 of the kind, the address and the page's id), so a rerun gives the same links. The metadata
record holds application/warc-fields: title, declared language, charset, outlinks in order and their number, sizes.
The conversion record holds the visible text: comments, script, style, head and nav are dropped, block tags break
lines, other tags go, character references are decoded, white space is folded. Both keep the source's headers in
`source_headers` and carry a block digest. A page may come with the headers of its response (a column `headers`, lines of
`Name: value`): these are kept as they are; those of type, language, length and digest are made of the body where the
response doesn't name them.

Pages are read in Arrow batches by compiled patterns that never look at a part of a page twice; a map over the scan without
a shuffle.

How html is read: a comment, and a script, style, head or nav with what it holds, ends at its first end mark; one without
an end mark is no such part. Attributes are in double, single or no quotes, their names in any case, with blanks around the
sign. Links are the href of a, in order, with repeats, outside of comments, scripts and styles. References are all those
of HTML, by name, decimal or hexadecimal, in text, title and attributes; what is none stays as it is. A no-break space
counts as a space.

Defined cases: a null or empty html has an empty text and no links; a null url is written as ''; a null page_id
hashes as ''; repeated rows give repeated records with equal identifiers; a digest is of UTF-8 bytes; pages of any length
are read whole; an empty table gives an empty result. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import col, ship

BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section footer header blockquote pre".split())
_ATTRIBUTES = r"""(?:[^<>"']|"[^"]*"|'[^']*')"""
_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'<>]+)"""
_TAG = re.compile(rf"<(?:[!?][a-zA-Z][^<>]*|/?([a-zA-Z][^\s<>/]*){_ATTRIBUTES}*+)>")
_OPEN = {True: re.compile(r"<(?:(!--)|(script|style)(?=[\s>]))", re.I), False: re.compile(r"<(?:(!--)|(head|nav)(?=[\s>]))", re.I)}
_CLOSE = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "head", "nav")} | {"!--": re.compile("-->")}
_NAMED = r"<{tag}(?:\s{attributes}*?)?\s{name}\s*=\s*{value}"
_HREF = re.compile(_NAMED.format(tag="a", attributes=_ATTRIBUTES, name="href", value=_VALUE), re.I)
_LANG = re.compile(_NAMED.format(tag="html", attributes=_ATTRIBUTES, name="lang", value=_VALUE), re.I)
_META = re.compile(r"""<meta\s(?:[^<>"']|["'])*?charset\s*=\s*["']?([a-zA-Z0-9_-]+)""", re.I)
_TITLE_OPEN, _TITLE_CLOSE = re.compile(r"<title(?:\s[^<>]*)?>", re.I), re.compile(r"</title", re.I)
_BLANKS, _LINES = re.compile(r"[ \t\r\f]+"), re.compile(r" ?\n[ \n]*")
_WHITE = re.compile(r"[ \t\r\n\f]+")

SCHEMA = "page_id {kind}, record_type string, record_id string, refers_to string, target_uri string, content_type string, source_headers string, block string, block_digest string, content_length bigint"


def _without(text: str, scripts: bool) -> str:
    """html with each comment, script and style (or comment, head and nav) replaced by a blank."""
    out, at, search, unclosed = [], 0, 0, set()
    while m := _OPEN[scripts].search(text, search):
        kind = (m[1] or m[2]).lower()
        end = None if kind in unclosed else _CLOSE[kind].search(text, m.end())
        if end is None:
            unclosed.add(kind)
            search = m.end()
            continue
        out += [text[at : m.start()], " "]
        at = search = end.end()
    return "".join(out) + text[at:] if out else text


def _plain(value: str) -> str:
    """An attribute's value without quotes, its references decoded."""
    return html.unescape(value[1:-1] if value[0] in "\"'" else value)


def _first(pattern: re.Pattern, text: str) -> str:
    m = pattern.search(text)
    return m[1] if m else ""


def read(page: str) -> dict:
    """text, title, language, charset and links of a page."""
    seen = _without(page, True)
    body = _without(seen, False)
    text = _TAG.sub(lambda m: "\n" if m[1] and m[1].lower() in BREAKS else "", body)
    if "&" in text:
        text = html.unescape(text)
    text = _LINES.sub("\n", _BLANKS.sub(" ", text.replace("\xa0", " "))).strip(" \n")
    title = ""
    if (m := _TITLE_OPEN.search(seen)) and (end := _TITLE_CLOSE.search(seen, m.end())):
        title = _WHITE.sub(" ", html.unescape(seen[m.end() : end.start()]).replace("\xa0", " "))
    language = _first(_LANG, seen)
    return {"text": text, "title": title, "language": _plain(language).lower() if language else "", "charset": _first(_META, seen).lower(), "links": [_plain(x) for x in _HREF.findall(seen)]}


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def _headers(given: str | None, page: str, found: dict) -> str:
    """The response's headers, and what the body tells of those it lacks."""
    lines = [x.strip() for x in (given or "").splitlines() if x.strip()]
    have = {x.split(":", 1)[0].strip().lower() for x in lines}
    raw = _utf8(page)
    own = [
        ("Content-Type", f"text/html; charset={found['charset'] or 'utf-8'}"), ("Content-Language", found["language"]),
        ("Content-Length", str(len(raw))), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(raw).hexdigest()),
    ]
    return "\r\n".join([*lines, *(f"{k}: {v}" for k, v in own if k.lower() not in have)])


def _urn_of(kind: str, url: str, id: str) -> str:
    h = hashlib.md5(f"{kind}|{url}|{id}".encode("utf-8", "replace")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def records(id: str, url: str, page: str, headers: str | None = None) -> list[tuple]:
    """The two records of a page: type, id, refers to, address, content type, source headers, block, digest, length."""
    x = read(page)
    said = "".join([f"title: {x['title']}\r\n", f"language: {x['language']}\r\n", f"charset: {x['charset']}\r\n", f"outlinks: {len(x['links'])}\r\n", *(f"outlink: {k}\r\n" for k in x["links"]), f"text-characters: {len(x['text'])}\r\n"])
    source, to = _headers(headers, page, x), _urn_of("response", url, id)
    out = []
    for kind, of, block in (("metadata", "application/warc-fields", said), ("conversion", "text/plain; charset=utf-8", x["text"])):
        raw = _utf8(block)
        out.append((kind, _urn_of(kind, url, id), to, url, of, source, raw.decode(), "sha256:" + hashlib.sha256(raw).hexdigest(), len(raw)))
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, at = [], []
        for k, (id, url, page, headers) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True)):
            found = records(id, url, page, headers)
            rows += found
            at += [k] * len(found)
        if rows:
            columns = list(zip(*rows, strict=True))
            names = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "source_headers", "block", "block_digest", "content_length"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, pa.string()) for c in columns[:8]), pa.array(columns[8], pa.int64())], names)


def derive(pages: DataFrame, headers: str | None = None) -> DataFrame:
    """Two records a page: page_id, record_type (metadata, conversion), record_id, refers_to (the response), target_uri,
    content_type, source_headers, block, block_digest, content_length. headers: a column of the response's headers."""
    ship(pages.sparkSession)
    some = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    rows = pages.select(col("page_id").alias("page_id"), some("page_id").alias("id"), some("url").alias("url"), some("html").alias("html"), (col(headers).cast("string") if headers else F.lit(None).cast("string")).alias("headers"))
    return rows.mapInArrow(_run, SCHEMA.format(kind=rows.schema["page_id"].dataType.simpleString()))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _urn(kind: str) -> str:
    h = f"md5('{kind}|' || url || '|' || id)"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _decoded(x: str) -> str:
    """DuckDB SQL: x with its references decoded that end with a semicolon, one after another from the left."""
    named = [(k[:-1], v) for k, v in sorted(html.entities.html5.items()) if k.endswith(";")]
    table = f"map([{', '.join(_lit(k) for k, _ in named)}], [{', '.join(_lit(v) for _, v in named)}])"
    number = "CASE WHEN e[3] IN ('x', 'X') THEN ('0x' || substr(e, 4, len(e) - 4))::BIGINT ELSE substr(e, 3, len(e) - 3)::BIGINT END"
    one = f"CASE WHEN e[2] = '#' THEN (CASE WHEN {number} BETWEEN 160 AND 55295 OR {number} BETWEEN 32 AND 126 THEN chr(({number})::INTEGER) ELSE e END) ELSE coalesce(names[substr(e, 2, len(e) - 2)], e) END"
    refs = f"regexp_extract_all({x}, '&(#[0-9]{{1,6}}|#[xX][0-9a-fA-F]{{1,5}}|[a-zA-Z][a-zA-Z0-9]*);')"
    between = f"string_split_regex({x}, '&(#[0-9]{{1,6}}|#[xX][0-9a-fA-F]{{1,5}}|[a-zA-Z][a-zA-Z0-9]*);')"
    return f"(SELECT list_aggregate(list_transform(range(1, len(b) + 1), lambda i: b[i] || CASE WHEN i <= len(r) THEN list_transform(r[i:i], lambda e: {one})[1] ELSE '' END), 'string_agg', '') FROM (SELECT {between} AS b, {refs} AS r, {table} AS names))"


def oracle() -> str:
    """DuckDB SQL for derive() over pages without response headers. It decodes references that end with a semicolon."""
    attributes = r"""(?:[^<>"']|"[^"]*"|'[^']*')"""
    tag = rf"<(?:[!?][a-zA-Z][^<>]*|/?[a-zA-Z][^\s<>/]*{attributes}*)>"
    breaks = rf"(?i)</?(?:{'|'.join(sorted(BREAKS, key=len, reverse=True))})(?:[\s/]{attributes}*)?>"
    sub = lambda x, p, to: f"regexp_replace({x}, {_lit(p)}, {to}, 'g')"
    named = lambda t, n: _lit("(?is)" + _NAMED.format(tag=t, attributes=attributes, name=n, value=_VALUE))
    bare = lambda x: f"CASE WHEN {x}[1] IN ('\"', '''') THEN substr({x}, 2, len({x}) - 2) ELSE {x} END"
    stripped = sub(sub("body", breaks, "chr(10)"), tag, "''")
    fold = lambda x: "trim(" + sub(sub(f"replace({x}, chr(160), ' ')", r"[ \t\r\f]+", "' '"), r" ?\n[ \n]*", "chr(10)") + ", ' ' || chr(10))"
    crlf = "chr(13), chr(10)"
    headers = f"concat('Content-Type: text/html; charset=', if(charset = '', 'utf-8', charset), {crlf}, 'Content-Language: ', language, {crlf}, 'Content-Length: ', strlen(html), {crlf}, 'WARC-Payload-Digest: sha256:', sha256(html))"
    said = f"concat('title: ', title, {crlf}, 'language: ', language, {crlf}, 'charset: ', charset, {crlf}, 'outlinks: ', len(links), {crlf}, array_to_string(list_transform(links, lambda x: concat('outlink: ', x, {crlf})), ''), 'text-characters: ', length(text), {crlf})"
    return rf"""
WITH r AS (
  SELECT row_number() OVER () AS n, page_id, coalesce(page_id::VARCHAR, '') AS id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), c AS (
  SELECT *, {sub("html", r"(?is)<!--.*?-->|<script[\s>].*?</script\s*>|<style[\s>].*?</style\s*>", "' '")} AS seen FROM r
), b AS (
  SELECT *, {sub("seen", r"(?is)<!--.*?-->|<head[\s>].*?</head\s*>|<nav[\s>].*?</nav\s*>", "' '")} AS body, coalesce(regexp_extract(seen, '(?is)<title(?:\s[^<>]*)?>(.*?)</title', 1), '') AS raw_title,
    coalesce(regexp_extract(seen, {named("html", "lang")}, 1), '') AS raw_language, lower(coalesce(regexp_extract(seen, {_lit(_META.pattern.replace("(?=", "(?:"))}, 1, 'i'), '')) AS charset,
    regexp_extract_all(seen, {named("a", "href")}, 1) AS raw_links FROM c
), d AS (
  SELECT *, {stripped} AS raw_text FROM b
), w AS (
  SELECT n, -2 AS k, raw_text AS x FROM d UNION ALL SELECT n, -1, raw_title FROM d UNION ALL SELECT n, generate_subscripts(raw_links, 1), unnest(raw_links) FROM d
), t AS (
  SELECT n, k, {_decoded("y")} AS y FROM (SELECT n, k, CASE WHEN k < 0 THEN x ELSE {bare("x")} END AS y FROM w)
), f AS (
  SELECT d.*, {fold("a.y")} AS text, {sub("replace(b.y, chr(160), ' ')", r"[ \t\r\n\f]+", "' '")} AS title, lower({bare("raw_language")}) AS language, coalesce(l.links, []) AS links
  FROM d JOIN t a ON a.n = d.n AND a.k = -2 JOIN t b ON b.n = d.n AND b.k = -1 LEFT JOIN (SELECT n, list(y ORDER BY k) AS links FROM t WHERE k > 0 GROUP BY n) l ON l.n = d.n
), e AS (
  SELECT page_id, {_urn("response")} AS refers_to, url AS target_uri, {headers} AS source_headers, 'metadata' AS record_type,
    {_urn("metadata")} AS record_id, 'application/warc-fields' AS content_type, {said} AS block FROM f
  UNION ALL
  SELECT page_id, {_urn("response")}, url, {headers}, 'conversion', {_urn("conversion")}, 'text/plain; charset=utf-8', text FROM f
)
SELECT *, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length FROM e"""
