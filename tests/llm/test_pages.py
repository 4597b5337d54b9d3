import datetime as dt
import gzip
import html.parser
import random
import re
import time

import pytest

from tessera.llm import html_text, warc


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; &lt;b&gt;", "plain & <b>"),
        ("<p>One<p>two <b>bold</b>  x<br>new", "One\n\ntwo bold x\nnew"),
        ("<ul><li>a<li>b<ol start=3><li>c<li value=9>d</ol></ul>z", "- a\n- b\n  3. c\n  9. d\n\nz"),
        ("<table><tr><th>Name<th>Val<tr><td>x<td>1,000<tr><td>longer<td hidden>no<td>2</table>", "Name    Val\nx       1,000\nlonger  2"),
        ("a<div style='display: none'>no</div><span hidden>no</span><script>var t='</p>';</script>b", "ab"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("x<!-- <p>no --> y<!--> z", "x y z"),
        ("a < b <1> c<", "a < b <1> c<"),
        ("<a title='x > y'>link</a> <input type=hidden value=no><img alt=pic>", "link pic"),
        ("<dl><dt>T<dd>D</dl><textarea>t</textarea>", "T\n  D\n\nt"),
        ("<table><td>a<td>b</table>", "a  b"),
        ("<div>a</div>\n<div>b</div><p hidden>c", "a\nb"),
        ("<pre>foo <b>bar</b> baz\n  <i>x</i>  y</pre>z", "foo bar baz\n  x  y\n\nz"),
        ("a<pre>\n\n  <span>def</span> f(x):\n\n      return <b>x</b>\n\n</pre>b", "a\n\n  def f(x):\n\n      return x\n\nb"),
        ("<pre>a<br>b &lt;c&gt;</pre><textarea>\n t\n</textarea>", "a\nb <c>\n\n t"),
        ("<li><pre>x\ny</pre>", "- x\ny"),
        ("<table><tr><th colspan=2>Name and value<th>N<tr><td>x<td>1<td>2<tr><td>yy<td>3<td>4</table>", "Name and value  N\nx   1           2\nyy  3           4"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>dd<td>e</table>", "a   b\n    c\ndd  e"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>e</table>", "a  b\n   c\n   e"),
        ("<table><tr><td colspan=1000 rowspan=9999>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td colspan=x>a<td colspan=0>b</table>", "a  b"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<div style='display:none'><b style='visibility:visible;display:block'>no</b></div>x", "x"),
        ("<style>.ad, p.no{display:none} #x{visibility:hidden} .ad#y{display:none}</style><p class='big ad'>no<p class=no>no<p>a<b id=x>no</b><i class=no>b", "ab"),
        ("<style>/* p{display:none} */ .a{display:none} .a{display:block} @media print{p{display:none}} i{display:none}</style><p class=a>x<i style='display:inline'>y</i>", "xy"),
        ("<p hidden style='display:block'>shown", "shown"),
    ],
)
def test_rendering(source, text):
    assert html_text.extract(source)[1] == text


def test_title_and_unclosed_quotes():
    assert html_text.extract("<head><title>A &amp;\n b</title></head><p>x")[0] == "A & b"
    assert html_text.extract("<p>x <b class=\"y>bold</b> <i>z</i>")[1] == "x bold z"
    assert html_text.extract("x<a href='")[1] == "x"


@pytest.mark.parametrize("depth", [10, 500, 20_000])
def test_depth_changes_nothing(depth):
    nested = "<div>" * depth + "<div hidden>secret</div>seen<span style='visibility:hidden'>secret</span>"
    assert html_text.extract(nested)[1] == "seen"
    assert html_text.extract("<ul><li>" * depth + "x")[1].strip() == "- x"
    deep = html_text.extract("<table><tr><td>a<td>" * depth + "<p hidden>secret</p>end")[1]
    assert deep.split() == ["a"] * depth + ["end"]
    # a closing tag finds its element wherever it is
    assert html_text.extract("<p>" + "<b>" * depth + "x</p>y")[1] == "x\n\ny"


class Words(html.parser.HTMLParser):
    """An independent parser: the words outside of what is never shown."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.pieces = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag not in html_text.VOID:
            self.open.append(tag)
        self.pieces.append(" " if tag in html_text.BLOCKS or tag == "br" else "")

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        self.pieces.append(" " if tag in html_text.BLOCKS else "")

    def handle_data(self, data):
        if not {"script", "style", "head", "title"} & set(self.open):
            self.pieces.append(data)


def test_words_are_those_of_an_independent_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    rows = {r.page_id: r for r in html_text.extract_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert len(rows) == len(pages)
    for page in pages:
        other = Words()
        other.feed(page.html)
        marked = [re.sub(r"^ *(?:-|[0-9]+\.) ", "", line) for line in rows[page.page_id].text.split("\n")]
        assert " ".join(marked).split() == "".join(other.pieces).split()
        assert rows[page.page_id].title == " ".join(html.unescape(re.search("<title>(.*?)</title>", page.html, re.S)[1]).split())


@pytest.mark.parametrize("source", ["<ul><li>x" * 30_000, "<table><tr><td>x<td>" * 10_000, "<td colspan=1000>x" * 3_000, "<table><tr>" + "<td rowspan=65534 colspan=1000>" * 300 + "<tr><td>" * 500, "<p><table>" + "<b>" * 9_000 + "</p>" * 9_000, "<div>" * 30_000 + "x", "<a" * 20_000, "<!--" * 9_000, "<table><tr><td>" * 2_000 + "y", '<b x="' * 5_000, "<li>" * 9_000, "</p>" * 5_000])
def test_hostile_pages_end_soon(source):
    html_text.extract(source)


def test_pages(spark, odd):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = html_text.extract_pages(pages).collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert "<" not in r.text and "track(" not in r.text and r.title and r.text.count("©") == 1
    made = html_text.extract_pages(odd, "doc_id", "text")
    assert made.count() == odd.count() and html_text.extract_pages(odd.limit(0), "doc_id", "text").count() == 0


def test_canonical_urls(spark):
    same = ["http://www.Ex.com:80/a/?utm_source=x&b=2&a=1#f", "https://u:p@ex.com/a?a=1&b=2", "https://ex.com/a/?b=2&a=1&fbclid=9"]
    frame = spark.createDataFrame([(u,) for u in [*same, "http://ex.com", "nothing", "", None, "http:///x"]], "u string")
    got = [r[0] for r in frame.select(warc.canonical_url(frame.u)).collect()]
    assert got == ["ex.com/a?a=1&b=2"] * 3 + ["ex.com", None, None, None, None]


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)


@pytest.mark.parametrize("parts", [1, 16])
def test_revisits_against_brute_force(spark, parts):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        full = rng.random() < 0.5
        url = "http://hot.example/" if rng.random() < 0.4 else f"http://h{rng.randrange(30)}.example/"
        headers = {k: v for k, v in (("ETag", rng.choice(['"1"', 'W/"1"', '"2"', ""])), ("Last-Modified", rng.choice(["d1", "d2", ""])), ("Content-Length", str(i)), ("X", str(i))) if v and rng.random() < 0.8}
        rows.append((f"r{i:04}", url, at(rng.randrange(300)), 200 if full else 304, headers))
    schema = "record_id string, url string, time timestamp, status int, headers map<string,string>"
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, schema).repartition(5), parts).collect()}
    assert got.keys() == {r[0] for r in rows if r[3] == 304}
    for rid, url, time, status, headers in rows:
        if status == 200:
            continue
        earlier = [r for r in rows if r[3] == 200 and r[1] == url and (r[2], r[0]) < (time, rid)]
        best = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        r = got[rid]
        assert r.refers_to == (best and best[0])
        own = {k.lower(): v for k, v in headers.items() if k != "Content-Length"}
        state = "missing"
        if best:
            theirs = {k.lower(): v for k, v in best[4].items()}
            state = "unvalidated"
            for name in ("last-modified", "etag"):
                if name in own and name in theirs:
                    state = "resolved" if own[name].removeprefix("W/") == theirs[name].removeprefix("W/") else "changed"
        assert r.state == state and r.headers == (theirs | own if state == "resolved" else own)


def test_odd_records(spark):
    schema = "record_id string, url string, time timestamp, status int, headers map<string,string>, _url string, state int"
    rows = [("a", None, at(1), 304, None, "x", 1), ("b", "http://e.x/", None, 304, {}, None, None), ("c", "http://e.x/", at(0), 200, None, None, 2), ("d", "http://e.x/", at(3), 304, None, None, 2), (None, None, None, None, None, None, None)]
    got = {r.record_id: (r.state, r.refers_to) for r in warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("missing", None), "b": ("missing", None), "d": ("unvalidated", "c")}
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_warc_files(spark, tmp_path):
    parts = [
        warc.record_bytes("<urn:1>", "http://e.x/a", "2024-01-01T00:00:00Z", "response", 200, {"ETag": '"1"', "Content-Type": "text/html"}, b"<p>hi\r\n\r\n</p>"),
        warc.record_bytes("<urn:2>", "http://e.x/a/", "2024-01-02T00:00:00Z", "revisit", 304, {"ETag": '"1"', "Expires": "never"}),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(parts))
    records = warc.read_warc(spark, str(tmp_path)).cache()
    assert [(r.record_id, r.status, bytes(r.body)) for r in records.orderBy("record_id").collect()] == [("<urn:1>", 200, b"<p>hi\r\n\r\n</p>"), ("<urn:2>", 304, b"")]
    [r] = warc.resolve_revisits(records).collect()
    assert (r.refers_to, r.state, r.headers) == ("<urn:1>", "resolved", {"etag": '"1"', "content-type": "text/html", "expires": "never"})


def record(i, body=b"x" * 50, kind="response", length=None):
    data = gzip.decompress(warc.record_bytes(f"<urn:{i}>", f"http://e.x/{i}", "2024-01-01T00:00:00Z", kind, 200, {"A": str(i)}, body))
    return data if length is None else re.sub(rb"Content-Length: [0-9]+", b"Content-Length: " + length, data, count=1)


def ids(data):
    return [r[0] for r in warc.parse_warc(data)]


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_malformed_records_are_passed_over(pack):
    good = [record(i, b"WARC/1.1 is text here\n" * i) for i in range(4)]
    assert ids(b"".join(map(pack, good))) == [f"<urn:{i}>" for i in range(4)]
    assert ids(pack(b"junk\nmore junk\n\n" + good[0]) + pack(good[1])) == ["<urn:0>", "<urn:1>"]
    assert ids(pack(record(7, length=b"many")) + pack(good[1])) == ["<urn:1>"]
    assert ids(pack(record(7, length=b"")) + pack(record(8, kind="metadata")) + pack(good[1])) == ["<urn:1>"]
    assert ids(pack(good[0]) + pack(good[1][:-60])) == ["<urn:0>"]
    assert ids(pack(good[0][:40])) == [] == ids(b"") == ids(pack(b""))


def test_repeated_fields_and_damaged_members():
    block = b"HTTP/1.1 200 X\r\nVary: a\r\nnot a field\r\nvary: b\r\n c\r\n\r\nbody"
    data = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <u>\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    [found] = warc.parse_warc(gzip.compress(data))
    assert found[4:] == (200, {"vary": "a, b c"}, b"body")
    members = [gzip.compress(record(i, random.Random(i).randbytes(5000))) for i in range(5)]
    broken = bytearray(members[2])
    broken[200:260] = bytes(60)
    got = ids(members[0] + members[1] + bytes(broken) + b"\0\0\0" + members[3] + members[4][:-900])
    assert got == ["<urn:0>", "<urn:1>", "<urn:3>"]
    assert ids(gzip.compress(b"".join(record(i) for i in range(9)))) == [f"<urn:{i}>" for i in range(9)]


def test_files_are_read_in_linear_time(spark, tmp_path):
    n = 20_000
    (tmp_path / "x.warc.gz").write_bytes(b"".join(warc.record_bytes(f"<urn:{i}>", "http://e.x/", "2024-01-01T00:00:00Z", "response", 200, {}, random.Random(i).randbytes(2000)) for i in range(n)))
    began = time.perf_counter()
    assert warc.read_warc(spark, str(tmp_path)).select("record_id").distinct().count() == n
    assert time.perf_counter() - began < 60
