"""WARC derivatives: linked metadata and plain-text conversion records built from responses.

Each response makes two records. The metadata record holds what the page says about itself (title, language, links out)
and the response's HTTP header fields; the conversion record holds the page's plain text. Both name the response they
were made from in WARC-Refers-To, keep its target URI, date and payload digest, and carry a digest of their own block.
Work goes response by response without a shuffle; a page is read once, by one pattern that finds its markup.

`read_records` and `responses` read WARC files, `responses_of` takes a table of pages, `write` makes files of records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.llm.common import slices, table

CRLF = "\r\n"
# Elements whose content is no text, and elements that end a line.
HIDDEN = ["script", "style", "noscript", "template", "iframe", "svg"]
BREAKING = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"

#: A comment, hidden element, title or tag runs to its end, or to the page's if it has none (so a page is read in linear
#: time); a name ends at a space, / or >.
MARKUP = re.compile(
    rf"<(?:(?P<gap>!--.*?(?:-->|\Z)|(?P<name>{'|'.join(HIDDEN)})(?:[\s/][^>]*)?>.*?(?:</(?P=name)\s*>|\Z))"
    rf"|title(?:[\s/][^>]*)?>(?P<title>.*?)(?:</title\s*>|\Z)"
    rf"|(?P<link>a\s[^>]*(?:>|\Z))|(?P<line>/?(?:{BREAKING})(?:[\s/][^>]*)?(?:>|\Z))|[a-z/!?][^>]*(?:>|\Z))",
    re.I | re.S,
)
HREF = re.compile(r"""\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LANGUAGE = re.compile(r"""html\s(?:[^>]*[\s"'])?lang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)
BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")


def parsed(page: str) -> tuple[str, str, list[str], str]:
    """(title, language, links, text) of a page.

    Title and language are the first ones, in no comment or hidden element; links are the targets of `a` elements in
    order. Text: comments, hidden elements and tags are left out, character references (named and numeric) decoded once,
    runs of blanks made one space, a line for each block, empty lines dropped. `<` that opens no name, `/`, `!` or `?` is
    text. A `>` inside an attribute value ends its tag.
    """
    title = language = None
    links: list[str] = []
    parts: list[str] = []
    at = 0
    for m in MARKUP.finditer(page):
        begin, end = m.span()
        if begin > at:
            parts.append(page[at:begin])
        at = end
        kind = m.lastgroup
        if kind is None:
            continue
        if kind == "line":
            parts.append("\n")
            if language is None and page[begin + 1 : begin + 5].lower() == "html":
                found = LANGUAGE.match(page, begin + 1, end)
                language = found[1] if found else None
        elif kind == "link":
            found = HREF.search(page, begin, end)
            if found:
                links.append(html.unescape(found[found.lastindex]).translate(_NO_LINES).strip(" "))
        elif kind == "title":
            parts += ["\n", m["title"], "\n"]
            if title is None:
                title = " ".join(filter(None, BLANKS.sub(" ", html.unescape(m["title"]).replace("\n", " ")).split(" ")))
        else:
            parts.append(" ")
    parts.append(page[at:])
    text = BLANKS.sub(" ", html.unescape("".join(parts)))
    lines = [s for s in (line.strip(" ") for line in text.split("\n")) if s]
    return title or "", language or "", links, "\n".join(lines)


_NO_LINES = str.maketrans("", "", "\t\r\n")
_IN_HEADER = str.maketrans({"\r": "%0D", "\n": "%0A"})


def sha1_base32(raw: bytes) -> str:
    """`sha1:` and the RFC 4648 base-32 form of the SHA-1 of some bytes."""
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(*names: str) -> str:
    """A record identifier that follows from the names alone, so a rerun makes the same records."""
    h = hashlib.md5("|".join(names).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def header_value(head: str, name: str) -> str | None:
    """First value of a field in lines of `Name: value`, whatever the name's case."""
    m = re.search(rf"^{re.escape(name)}[ \t]*:[ \t]*(.*?)[ \t\r]*$", head, re.I | re.M)
    return m[1] if m else None


def decoded(payload: bytes, head: str) -> str:
    """Text of a payload: chunks joined and gzip or deflate undone where the header says so, then its charset or UTF-8.

    What cannot be undone is read as it stands; bytes that are none of the charset's become U+FFFD.
    """
    if "chunked" in (header_value(head, "Transfer-Encoding") or "").lower():
        payload = _unchunked(payload)
    if any(c in (header_value(head, "Content-Encoding") or "").lower() for c in ("gzip", "deflate")):
        try:
            payload = zlib.decompressobj(zlib.MAX_WBITS | 32).decompress(payload)
        except zlib.error:
            pass
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", header_value(head, "Content-Type") or "", re.I)
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _unchunked(payload: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        size = re.fullmatch(rb"\s*([0-9A-Fa-f]+)\s*(?:;.*)?", payload[at:end], re.S) if end >= 0 else None
        if not size:
            return b"".join(out) if out or size else payload
        n = int(size[1], 16)
        if n == 0:
            return b"".join(out)
        out.append(payload[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


RESPONSES = "page_id BIGINT, record_id STRING, target_uri STRING, date STRING, http_headers STRING, payload BINARY"


def responses_of(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages (page_id, url, html); nulls become empty strings, rows that repeat stay.

    The table has no HTTP header, so one is made: status, type and length.
    """
    url, payload = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = F.col("page_id").cast("long")
    h = F.md5(F.concat_ws("|", F.lit("response"), F.coalesce(page.cast("string"), F.lit("")), url))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        page.alias("page_id"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF)).alias("http_headers"),
        payload.cast("binary").alias("payload"),
    )


RECORDS = "page_id BIGINT, warc_type STRING, record_id STRING, refers_to STRING, target_uri STRING, date STRING, content_type STRING, content_length BIGINT, block_digest STRING, source_digest STRING, headers STRING, block STRING"


def _derived(page_id, refers_to, uri, date, head, payload) -> Iterator[tuple]:
    refers_to, uri, date, head, payload = refers_to or "", uri or "", date or "", head or "", payload or b""
    title, language, links, text = parsed(decoded(payload, head))
    fields = "".join([f"title: {title}{CRLF}" if title else "", f"language: {language}{CRLF}" if language else "", *[f"outlink: {x}{CRLF}" for x in links], head])
    source = sha1_base32(payload)
    shown = uri.translate(_IN_HEADER)
    for kind, content_type, block in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", text)):
        raw = block.encode("utf-8", "replace")
        digest, own = sha1_base32(raw), record_id(kind, refers_to)
        lines = [
            "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}", *([f"WARC-Target-URI: {shown}"] if shown else []), f"WARC-Refers-To: {refers_to}",
            f"WARC-Source-Payload-Digest: {source}", f"WARC-Block-Digest: {digest}", f"Content-Type: {content_type}", f"Content-Length: {len(raw)}", "",
        ]
        yield page_id, kind, own, refers_to, uri, date, content_type, len(raw), digest, source, CRLF.join(lines), raw.decode()


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response (page_id, record_id, target_uri, date, http_headers, payload).

    Columns: page_id, warc_type, record_id, refers_to, target_uri, date, content_type, content_length, block_digest,
    source_digest (of the payload's bytes), headers (the WARC header fields), block. An empty or null payload makes an
    empty text and a metadata record without page fields; other nulls are empty texts. A page of any length is read
    whole, in time that grows with its length. Rows that repeat make records that repeat; an empty table makes none.
    Columns other than the six are not read.
    """
    names = [c.split()[0] for c in RESPONSES.split(", ")]

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("BIGINT") else pa.string()) for c in RECORDS.split(", ")])
        for batch in slices(batches, 128):
            rows = [r for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True) for r in _derived(*row)]
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return responses.select(F.col("page_id").cast("long").alias("page_id"), *[F.col(n).cast("string").alias(n) for n in names[1:5]], F.col("payload").cast("binary").alias("payload")).mapInArrow(made, RECORDS)


def records(derived: DataFrame) -> DataFrame:
    """`derived` with `record`: each record's bytes as they stand in a WARC file."""
    return derived.withColumn("record", F.concat(F.col("headers"), F.lit(CRLF), F.col("block"), F.lit(CRLF * 2)).cast("binary"))


def write(derived: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files of all records below `path`, one for each partition."""
    lines = derived.select(F.concat(F.col("headers"), F.lit(CRLF), F.col("block")).alias("value"))
    lines.write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All records of WARC files, plain or gzip: warc_type, record_id, target_uri, date, headers, block (bytes), whole.

    Files are read by Spark's text reader, cut where a record may begin. A block that holds such a place itself is joined
    again by its Content-Length. `whole` is False where the length says more than the file has.
    """
    cut = b"\r\n\r\nWARC/"

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("headers", pa.string()), ("block", pa.binary()), ("whole", pa.bool_())])

        def row(piece: bytes) -> dict:
            head, _, block = piece.partition(b"\r\n\r\n")
            head, want = head.decode("utf-8", "replace"), length(piece)
            return {
                "warc_type": header_value(head, "WARC-Type"), "record_id": header_value(head, "WARC-Record-ID"), "target_uri": header_value(head, "WARC-Target-URI"),
                "date": header_value(head, "WARC-Date"), "headers": head, "block": block[: want if want is not None else None], "whole": want is not None and len(block) >= want,
            }

        def length(piece: bytes) -> int | None:
            found = header_value(piece.partition(b"\r\n\r\n")[0].decode("utf-8", "replace"), "Content-Length")
            return int(found) if found and found.isdigit() else None

        held: list[bytes] = []
        missing = 0
        for batch in slices(batches, 128):
            out = []
            for value in batch.column("value").to_pylist():
                if held and missing > 0:
                    # the last block goes on: what was cut off belongs to it
                    held += [cut, value]
                    missing -= len(cut) + len(value)
                    continue
                if held:
                    out.append(row(b"".join(held)))
                piece = value if value.startswith(b"WARC/") else b"WARC/" + value
                held, missing = [piece], (length(piece) or 0) - len(piece.partition(b"\r\n\r\n")[2])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([row(b"".join(held))], schema)

    raw = spark.read.option("lineSep", cut.decode()).text(path).select(F.col("value").cast("binary").alias("value")).where("length(value) > 0")
    return raw.mapInArrow(joined, "warc_type STRING, record_id STRING, target_uri STRING, date STRING, headers STRING, block BINARY, whole BOOLEAN")


def responses(found: DataFrame) -> DataFrame:
    """The response records among `found` (of `read_records`) in the form that `derive` takes; page_id is null."""
    end = F.position(F.lit(b"\r\n\r\n"), F.col("block"))
    return found.where("warc_type = 'response' and whole").select(
        F.lit(None).cast("long").alias("page_id"), "record_id", "target_uri", "date",
        F.when(end > 0, F.concat(F.substring("block", 1, end - 1).cast("string"), F.lit(CRLF))).otherwise("").alias("http_headers"),
        F.when(end > 0, F.col("block").substr(end + 4, F.length("block"))).otherwise(F.col("block")).alias("payload"),
    )


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records(derive(responses_of(table(spark, sf_dir, "pages"))))
    return out.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_length", "block_digest", "source_digest", F.sha1("record").alias("record_sha1"))


# DuckDB's own way to the same rows: several passes over a page, references decoded part by part after each `&`.
OP7_SQL = r"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')) AS h FROM pages
), s AS (
  SELECT page_id, target_uri, payload, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS refers_to,
    regexp_replace(payload, '(?is)<!--.*?(-->|\z)|<script([\s/][^>]*)?>.*?(</script\s*>|\z)|<style([\s/][^>]*)?>.*?(</style\s*>|\z)|<noscript([\s/][^>]*)?>.*?(</noscript\s*>|\z)|<template([\s/][^>]*)?>.*?(</template\s*>|\z)|<iframe([\s/][^>]*)?>.*?(</iframe\s*>|\z)|<svg([\s/][^>]*)?>.*?(</svg\s*>|\z)', ' ', 'g') AS shown
  FROM r
), p AS (
  SELECT *, regexp_extract(shown, '(?i)<html\s([^>]*[\s"''])?lang\s*=\s*["'']?([a-z0-9-]+)', 2) AS lang, regexp_extract(shown, '(?is)<title([\s/][^>]*)?>(.*?)</title\s*>', 2) AS title_raw,
    regexp_extract_all(shown, '(?is)<a\s[^>]*(>|\z)') AS anchors,
    regexp_replace(regexp_replace(shown, '(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)([\s/][^>]*)?(>|\z)', chr(10), 'g'), '(?i)<[a-z/!?][^>]*(>|\z)', '', 'g') AS bare
  FROM s
), q AS (
  SELECT *, {title} AS title_text, {bare} AS text_raw, list_transform(list_filter(list_transform(anchors, lambda a: regexp_extract(a, '(?i)\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)), lambda x: x <> ''), lambda x: trim(regexp_replace(trim(x, '"'''), '[\t\r\n]', '', 'g'))) AS hrefs FROM p
), b AS (
  SELECT page_id, target_uri, refers_to, payload, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    CASE WHEN trim(title_text) <> '' THEN 'title: ' || trim(regexp_replace(title_text, '[ \t\r\n\f\v\x{A0}]+', ' ', 'g')) || chr(13) || chr(10) ELSE '' END || CASE WHEN lang <> '' THEN 'language: ' || lang || chr(13) || chr(10) ELSE '' END
      || coalesce(array_to_string(list_transform(hrefs, lambda u: 'outlink: ' || ({u}) || chr(13) || chr(10)), ''), '')
      || 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload) || chr(13) || chr(10) AS block FROM q
  UNION ALL
  SELECT page_id, target_uri, refers_to, payload, 'conversion', 'text/plain; charset=utf-8',
    array_to_string(list_filter(list_transform(string_split(regexp_replace(text_raw, '[ \t\r\f\v\x{A0}]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) FROM q
), d AS (
  SELECT *, strlen(block) AS content_length, sha1(block) AS bh, sha1(payload) AS ph, md5(warc_type || '|' || refers_to) AS h FROM b
), e AS (
  SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS record_id, {block_digest} AS block_digest, {source_digest} AS source_digest FROM d
)
SELECT page_id, warc_type, record_id, refers_to, target_uri, content_length, block_digest, source_digest,
  sha1(array_to_string(list_filter(['WARC/1.1', 'WARC-Type: ' || warc_type, 'WARC-Record-ID: ' || record_id, 'WARC-Date: 1970-01-01T00:00:00Z', CASE WHEN target_uri <> '' THEN 'WARC-Target-URI: ' || target_uri END,
    'WARC-Refers-To: ' || refers_to, 'WARC-Source-Payload-Digest: ' || source_digest, 'WARC-Block-Digest: ' || block_digest, 'Content-Type: ' || content_type, 'Content-Length: ' || content_length, '', block || chr(13) || chr(10) || chr(13) || chr(10)],
    lambda x: x IS NOT NULL), chr(13) || chr(10))) AS record_sha1
FROM e
"""


def _references_sql(c: str) -> str:
    """Character references: numeric ones, the names that a map has, and those that stand without a semicolon too."""
    names = "MAP {'lt': '<', 'gt': '>', 'quot': '\"', 'apos': '\'\'', 'nbsp': chr(160), 'copy': '©', 'reg': '®', 'trade': '™', 'middot': '·', 'bull': '•', 'hellip': '…', 'ndash': '–', 'mdash': '—', 'lsquo': '‘', 'rsquo': '’', 'ldquo': '“', 'rdquo': '”', 'laquo': '«', 'raquo': '»', 'euro': '€', 'amp': '&'}"
    bare = "'^(amp|lt|gt|quot|nbsp|copy|reg|middot|laquo|raquo)'"
    one = (
        f"CASE WHEN regexp_matches(z, '^#[0-9]') THEN chr(regexp_extract(z, '^#([0-9]+)', 1)::INT) || regexp_replace(z, '^#[0-9]+;?', '') "
        f"WHEN regexp_matches(z, '^#[xX][0-9a-fA-F]') THEN chr(('0x' || regexp_extract(z, '^#[xX]([0-9a-fA-F]+)', 1))::INT) || regexp_replace(z, '^#[xX][0-9a-fA-F]+;?', '') "
        f"WHEN regexp_matches(z, '^[A-Za-z]+;') AND ({names})[split_part(z, ';', 1)] IS NOT NULL THEN ({names})[split_part(z, ';', 1)] || regexp_replace(z, '^[^;]*;', '') "
        f"WHEN regexp_matches(z, {bare}) THEN ({names})[regexp_extract(z, {bare}, 1)] || regexp_replace(z, {bare}, '') ELSE '&' || z END"
    )
    return f"array_to_string(list_transform(string_split({c}, '&'), lambda z, i: CASE WHEN i = 1 THEN z ELSE {one} END), '')"


def _base32_sql(h: str) -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    return "'sha1:' || " + " || ".join(f"substr({letters}, ((('0x' || substr({h}, {5 * k + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))


for _name, _text in {"title": _references_sql("title_raw"), "bare": _references_sql("bare"), "u": _references_sql("u"), "block_digest": _base32_sql("bh"), "source_digest": _base32_sql("ph")}.items():
    OP7_SQL = OP7_SQL.replace("{" + _name + "}", _text)
