import datetime
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.functions.urls import Scope
from lexmill.operators import crawl, html
from lexmill.sources import http, pdf
from lexmill.sources import store as stores
from lexmill.streaming import updates

PAGE = """<html><head><title>Site</title><script>var a="<p>";</script></head><body><a href="/out">dış</a>
<main id="mainContent"><div class="menu"><a href="/m?b=a+b==">Menü</a></div><button class="kontrol x">Kitaplar</button><h1>Duyuru Detay</h1><h1>Gerçek <b>Başlık</b></h1>
<h6>Dr. Ad</h6><p>Bir &amp; iki<br>üç</p><a href="#x">no</a><a href="mailto:a@b">no</a><a href="rel">Göreli</a>
<table><tr><th>Kod</th><td> </td><td>Ad</td></tr><tr><td>YAZ102<td>Algo</table><iframe src="doc/a.PDF?x"></iframe></main></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([("http://a.edu/d/p", PAGE), ("http://a.edu", ""), (None, None), ("http://a.edu", "<p>x <b>y<i>z")], "url string, html string")
    p = html.HtmlParams(noise_classes=frozenset({"menu"}))
    rows = [r.page for r in html.extract(df, p=p).collect()]
    assert rows[0].title == "GerçekBaşlık" and rows[0].person == "Dr. Ad"
    assert rows[0].text == "Duyuru Detay\nGerçek\nBaşlık\nDr. Ad\nBir & iki\nüç\nno\nno\nGöreli\nKod | Ad\nYAZ102 | Algo"
    assert rows[0].tables == "Kod | Ad\nYAZ102 | Algo"
    assert [(x.text, x.url) for x in rows[0].links] == [("Menü", "http://a.edu/m?b=a+b=="), ("Göreli", "http://a.edu/d/rel")]
    assert rows[0].pdfs == ["http://a.edu/d/doc/a.PDF?x"]
    assert [(r.title, r.text, r.links) for r in rows[1:3]] == [("", "", []), ("", "", [])]
    assert rows[3].text == "x\ny\nz"
    assert html.links(html.extract(df, p=p)).count() == 2


def test_script_calls(spark):
    df = spark.createDataFrame([("derslistegetir(5) x derslistegetir(4) derslistegetir(5) Sayfa_Getir('A','tok+=')",), ("",)], "h string")
    assert [tuple(r) for r in df.select(html.program_ids(F.col("h")), html.person_token(F.col("h"))).collect()] == [(["5", "4"], "tok+="), ([], None)]
    tabs = spark.createDataFrame([("u", 2, "B", "b"), ("u", 1, "A", " a "), ("u", 3, "C", " "), ("v", 1, "A", None)], "url string, tab_no int, label string, body string")
    assert [tuple(r) for r in html.person_text(tabs).collect()] == [("u", "A\na\n\nB\nb")]


IMPLIED = [
    ("<h1>T<h2>U</h2><p>x", "T", "T\nU\nx"),
    ("<h1>Title<p>text<p>more<ul><li>a<li>b<ul><li>c</ul><li>d</ul>end", "Title", "Title\ntext\nmore\na\nb\nc\nd\nend"),
    ("<h1><div>In a div</div></h1><p>x", "In a div", "In a div\nx"),
    ("<h1>One</h2><p>Two", "One", "One\nTwo"),
    ("<h2>H<table><tr><td>a<td>b<tr><td>c<td>d</table>after", "H", "H\na | b\nc | d\nafter"),
    ("<h3>A</h3><table><thead><tr><th>k<th>v<tbody><tr><td>1<td>2</table>", "A", "A\nk | v\n1 | 2"),
    ("<h1>A</h1><table><tr><td>x</div>y</td><td>z</td></tr></table><p>q", "A", "A\nx y | z\nq"),
    ("<h1>A</h1><dl><dt>k<dd>v<dt>l<dd>w</dl>", "A", "A\nk\nv\nl\nw"),
    ("<head><title>S</title><body><p>x", "S", "x"),
]


@pytest.mark.parametrize("page,title,text", IMPLIED)
def test_implied_ends(page, title, text):
    assert html.fields_of(page, "http://a/", html.HtmlParams())[:2] == (title, text)


def test_links_left_open_and_deep_nests():
    links = html.fields_of("<a href=/x>one<a href=/y>two</a><p>three", "http://a/", html.HtmlParams())[4]
    assert [(x["text"], x["url"]) for x in links] == [("one", "http://a/x"), ("two", "http://a/y")]
    began = time.time()
    html.fields_of("<p><a href=/x>" + "<b>" * 30_000 + "<div></i>" * 10_000, "http://a/", html.HtmlParams())
    assert time.time() - began < 10


def test_crawl(spark):
    edges = spark.createDataFrame([("http://a.edu/", "http://a.edu/b#x", 0), ("http://a.edu/", "http://a.edu/c", 1), ("http://a.edu/b", "http://A.edu/c/", 0), ("http://a.edu/b", "http://a.edu/d", 1), ("http://a.edu/d", "http://a.edu/e", 0), ("http://a.edu/", "http://z.edu/q", 2), ("http://a.edu/", None, 3)], "url string, link_url string, place int")
    seeds = spark.createDataFrame([("http://a.edu",), ("http://a.edu/#again",), (None,)], "url string")
    got = sorted((r.key, r.depth, r.from_key) for r in crawl.traverse(edges, seeds, Scope(hosts=("a.edu",))).collect())
    assert got == [("http://a.edu/", 0, None), ("http://a.edu/b", 1, "http://a.edu/"), ("http://a.edu/c", 1, "http://a.edu/"), ("http://a.edu/d", 2, "http://a.edu/b")]
    only = crawl.CrawlParams(units_only=True, unit_marker="/b")
    assert {r.key for r in crawl.traverse(edges, spark.createDataFrame([("http://a.edu/b",)], "url string"), Scope(hosts=("a.edu",)), only).collect()} == {"http://a.edu/b"}
    assert crawl.traverse(edges.limit(0), seeds.limit(0), Scope(hosts=("a.edu",))).count() == 0


@pytest.fixture
def server():
    hits: list = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            hits.append(self.path)
            status = 404 if self.path == "/no" else 500 if self.path == "/flaky" and hits.count("/flaky") < 2 else 200
            self.send_response(status)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(b"<p>hi")

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", hits
    s.shutdown()


def test_http_source(spark, tmp_path, server):
    root, hits = server
    urls = str(tmp_path / "urls")
    spark.createDataFrame([(f"{root}{x}",) for x in ("/a?b=a+b==", "/no", "/flaky")] + [(None,)], "url string").write.parquet(urls)
    spark.dataSource.register(http.HttpSource)
    got = spark.read.format("lexmill_http").option("urls", urls).option("pause", "0.01").load().collect()
    assert sorted((r.url.removeprefix(root), r.status, bytes(r.body)) for r in got) == [("/a?b=a+b==", 200, b"<p>hi"), ("/flaky", 200, b"<p>hi")]
    assert sorted(hits) == ["/a?b=a+b==", "/flaky", "/flaky", "/no"]


def test_pdf(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.pdf").write_bytes(b"broken")

    def pages(body: bytes) -> list[str]:
        if b"broken" in body:
            raise ValueError("broken")
        return body.decode().split("|")

    df = pdf.text(pdf.read(spark, str(tmp_path)), pages).withColumn("menu", F.lit(None).cast("string"))
    assert sorted((r.title, r.text, r.doc_type) for r in pdf.pdf_records(df).collect()) == [("a.pdf (PDF)", "one\ntwo", "pdf"), ("b.pdf (PDF)", "", "pdf")]


def test_streams(spark, tmp_path):
    schema = "url string, fetched_at string, content_hash string"
    source, store = str(tmp_path / "in"), stores.open_store(spark, str(tmp_path / "store"), schema=StructType.fromDDL(schema), buckets=4)
    spark.createDataFrame([("a", "1", "h"), ("b", "1", "h")], schema).coalesce(1).write.parquet(source)
    stream = lambda: updates.upsert_stream(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "cp")).awaitTermination()
    stream()
    spark.createDataFrame([("a", "2", "h"), ("b", "2", "g")], schema).coalesce(1).write.mode("append").parquet(source)
    stream()
    assert sorted(map(tuple, store.read().collect())) == [("a", "1", "h"), ("b", "2", "g")]
    log = str(tmp_path / "log")
    t = datetime.datetime(2026, 1, 1, 10, 5)
    spark.createDataFrame([(t, "x"), (t, "x"), (t + datetime.timedelta(hours=1), "y")], "asked_at timestamp, reason string").write.parquet(log)
    q = updates.unanswered_rates(spark.readStream.schema("asked_at timestamp, reason string").parquet(log)).writeStream.format("memory").queryName("rates").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.start.hour, r.reason, r.n) for r in spark.table("rates").collect()) == [(10, "x", 2), (11, "y", 1)]
