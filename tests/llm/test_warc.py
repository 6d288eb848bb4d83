"""WARC derivatives against a page reader built on the standard library's parser, and files against what was written."""

import base64
import gzip
import hashlib
import random
import time
from html.parser import HTMLParser

from factflow.llm import warc


class Reader(HTMLParser):
    """Text, title and links by the standard library's parser: well-formed pages only."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.title, self.hidden, self.in_title = [], [], "", 0, False

    def handle_starttag(self, tag, attrs):
        if tag in warc.HIDDEN:
            self.hidden += 1
            self.out.append(" ")
        elif not self.hidden:
            if tag == "a":
                self.links += [v for k, v in attrs if k == "href"][:1]
            self.in_title = tag == "title"
            if tag in [*warc.BREAKING.split("|"), "title"]:
                self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in warc.HIDDEN:
            self.hidden -= 1
        elif not self.hidden:
            self.in_title = False
            if tag in [*warc.BREAKING.split("|"), "title"]:
                self.out.append("\n")

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)
            if self.in_title:
                self.title += data

    def text(self):
        lines = ("".join(self.out).replace("\xa0", " ")).split("\n")
        return "\n".join(s for s in (" ".join(x for x in line.replace("\t", " ").split(" ") if x) for line in lines) if s)


def pages(n=200, seed=4):
    rng = random.Random(seed)
    words = ["one", "Two", "&amp;", "&#8217;", "&#x27;", "&lt;b&gt;", "&copy;", "&nbsp;", "é", "3 < 4", "a&b", "&amp;lt;", "\n", "\t"]
    out = []
    for _ in range(n):
        body = []
        for _ in range(rng.randrange(12)):
            w = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))
            body.append(rng.choice([f"<p>{w}</p>", f"<b class=x>{w}</b>", f'<a class="l" href="/q?a=1&amp;b={len(body)}">{w}</a>', f"<A HREF='x'>{w}</A>", f"<!-- {w} <p> -->", "<br/>", f"<script>if (a<b) {{'</p>'}}</script>", f"<DIV>{w}</div>", "<style >p{}</style>", w]))
        out.append(f"<!DOCTYPE html><html><head><title>{rng.choice(words)} t</title></head><body>{''.join(body)}</body></html>")
    return out


def test_pages_against_the_standard_parser():
    for page in pages():
        want = Reader()
        want.feed(page)
        want.close()
        title, _, links, text = warc.parsed(page)
        assert (text, links) == (want.text(), want.links), page
        assert title == " ".join(want.title.replace("\xa0", " ").split())


def test_markup_without_an_end_and_long_pages():
    assert warc.parsed("a<!-- b")[3] == "a" and warc.parsed("a<script>b")[3] == "a" and warc.parsed("x <y")[3] == "x" and warc.parsed("x < y")[3] == "x < y"
    assert warc.parsed('<html class=a lang="de-AT"><p lang=fr>')[1] == "de-AT"
    assert warc.parsed("<a href=/x>1</a><area href=/y><abbr href=/z>")[2] == ["/x"]
    began = time.time()
    for page in ("<!-- <script " * 200_000, "<a " * 300_000, "<title>" * 300_000, "&" * 1_000_000, "word <b>" * 300_000):
        warc.parsed(page)
    assert time.time() - began < 30


def test_nulls_empty_tables_repeats_and_other_columns(spark):
    schema = "page_id long, url string, html string, block string, headers string, warc_type string"
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>", "b", "h", "t"), (None, None, None, None, None, None), (1, "u", "", None, None, None), (1, "u", "", None, None, None), (5, "u", "<p>" + "long " * 100_000, None, None, None)]
    got = warc.records(warc.derive(warc.responses_of(spark.createDataFrame(rows, schema)))).collect()
    assert len(got) == 10 and all(r.content_length == len(r.block.encode()) for r in got)
    assert sorted(r.block for r in got if r.page_id is None and r.warc_type == "conversion") == [""]
    assert any(b"WARC-Target-URI: http://a/%0D%0AX: y\r\n" in bytes(r.record) for r in got)
    assert warc.derive(warc.responses_of(spark.createDataFrame([], schema))).count() == 0


def record(kind, rid, block, uri="http://x/"):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2020-01-02T03:04:05Z\r\ncontent-length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_reads_warc_files(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nX-A: 1"
    odd = http + b"\r\n\r\n<p>caf\xe9</p>\r\n\r\nWARC/1.0 is a format\r\n\r\nWARC/2"
    packed = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n"
    body = gzip.compress(b"<p>zipped</p>")
    packed += b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body)
    parts = [record("warcinfo", "<i>", b"software: x"), record("response", "<r1>", odd), record("request", "<q>", b"GET /"), record("response", "<r2>", packed), record("response", "<r3>", b"no header")]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts) + gzip.compress(record("response", "<cut>", b"x" * 90)[:200]))
    for name, n in (("a.warc", 5), ("b.warc.gz", 6)):
        found = warc.read_records(spark, str(tmp_path / name))
        assert found.count() == n and [r.record_id for r in found.where("not whole").collect()] == ([] if n == 5 else ["<cut>"])
        assert bytes(found.where("record_id = '<r1>'").first().block) == odd
        got = {(r.refers_to, r.warc_type): r for r in warc.derive(warc.responses(found)).collect()}
        assert len(got) == 6
        assert got["<r1>", "conversion"].block == "café\nWARC/1.0 is a format\nWARC/2" and got["<r2>", "conversion"].block == "zipped" and got["<r3>", "conversion"].block == "no header"
        assert "X-A: 1" in got["<r1>", "metadata"].block and got["<r1>", "metadata"].date == "2020-01-02T03:04:05Z"
        assert got["<r1>", "conversion"].source_digest == "sha1:" + base64.b32encode(hashlib.sha1(odd.partition(b"\r\n\r\n")[2]).digest()).decode()


def test_written_files_are_read_back(spark, tmp_path):
    rows = [(k, f"http://p/{k}", p) for k, p in enumerate(pages(20))]
    derived = warc.derive(warc.responses_of(spark.createDataFrame(rows, "page_id long, url string, html string")))
    warc.write(derived, str(tmp_path / "out"))
    want = {(r.record_id, r.warc_type, r.target_uri, r.block) for r in derived.collect()}
    back = warc.read_records(spark, str(tmp_path / "out")).collect()
    assert all(r.whole for r in back) and {(r.record_id, r.warc_type, r.target_uri, bytes(r.block).decode()) for r in back} == want
