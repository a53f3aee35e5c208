"""A crawl over pages that a table or a local server holds."""

import datetime
import http.server
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.functions.urls import Scope
from lexmill.operators import crawler, html
from lexmill.operators.crawl import CrawlParams
from lexmill.sources import http as source
from lexmill.sources import store

TEXT = "long enough to be a record of its own"
PAGES = {
    "/": f"<body><h1>Start</h1><p>{TEXT}</p><a href='/b'>B</a><a href='/a'>A</a><a href='/gone'>G</a><a href='http://other/'>O</a><iframe src='/f.pdf'></iframe></body>",
    "/a": f"<body><h1>Page A</h1><p>{TEXT}</p><a href='/'>up</a><a href='/deep'>D</a><p onclick='derslistegetir(4)'>l</p></body>",
    "/b": f"<body><h1>Page B</h1><p>{TEXT}</p><a href='/a#x'>A again</a><a href='/?prsnl=7'>P</a><a href='/?prsnl=8'>Q</a></body>",
    "/deep": f"<body><h1>Deep</h1><p>{TEXT}</p><a href='/deeper'>no</a></body>",
    "/deeper": f"<body><h1>Deeper</h1><p>{TEXT}</p></body>",
    "/?prsnl=8": f"<body><h6>Dr. Sekmesiz</h6><p>{TEXT}</p></body>",
    "/?prsnl=7": "<body><h6>Dr. Ad Soyad</h6><p>Fakülte ve bölüm</p><i onclick=\"Sayfa_Getir('t','tok=')\"></i></body>",
    "/list?id=4": "<body><table><tr><td>YAZ101</td><td>Bir ders adi burada</td></tr></table></body>",
}


def handler(seen):
    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, kind, body):
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            seen.append(self.path)
            if self.path == "/f.pdf":
                self.answer("application/pdf", b"text of a file that is long enough")
            elif self.path in PAGES:
                self.answer("text/html; charset=utf-8", PAGES[self.path].encode())
            else:
                self.send_error(404)

        def do_POST(self):
            data = self.rfile.read(int(self.headers["Content-Length"])).decode()
            seen.append((self.path, data))
            if self.path.endswith("/broken/DersListesi"):
                self.send_error(500)
            else:
                self.answer("text/html", f"<body><p>tab {self.path} of {data}</p></body>".encode())

        def log_message(self, *args):
            pass

    return Handler


@pytest.fixture
def site():
    seen: list = []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler(seen))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}", seen
    server.shutdown()


def run(spark, base, tabs="tab", **params):
    scope = Scope(hosts=(base[7:],))
    fetch = lambda requests: source.fetched(requests, pause="0", token=html.TOKEN)
    seeds = spark.createDataFrame([(f"{base}/",), (f"{base}/#again",)], "url string")
    return crawler.crawl(seeds, fetch, scope, datetime.date(2026, 1, 1), "2026-01-01T00:00:00", lambda b: [b.decode()], crawler.PersonTabs(f"{base}/{tabs}"), f"{base}/list", CrawlParams(**params))


def test_crawl(spark, site, tmp_path):
    base, seen = site
    done = run(spark, base, depth=2)
    visits = {r.key[len(base) :]: (r.depth, (r.from_key or "")[len(base) :], r.status) for r in done.visits.collect()}
    assert visits == {"/": (0, "", 200), "/f.pdf": (0, "/", 200), "/b": (1, "/", 200), "/a": (1, "/", 200), "/gone": (1, "/", 404), "/deep": (2, "/a", 200), "/?prsnl=7": (2, "/b", 200), "/?prsnl=8": (2, "/b", 200)}
    records = {r.url[len(base) :]: r for r in done.records.collect()}
    assert set(records) == {"/", "/f.pdf", "/b", "/a", "/deep", "/?prsnl=7", "/?prsnl=8", "/list?id=4"}
    own = "Dr. Ad Soyad\nFakülte ve bölüm"
    assert records["/?prsnl=7"].title == "Dr. Ad Soyad" and records["/?prsnl=7"].text == f"{own}\n\nAkademik Görevler ve Öğrenim Bilgisi\ntab /tab/KisiselBilgiler of id=tok%3D\n\nVerdiği Dersler\ntab /tab/DersListesi of id=tok%3D"
    assert records["/?prsnl=8"].title == "Dr. Sekmesiz" and records["/?prsnl=8"].text.endswith(TEXT)  # no token, no request
    assert records["/list?id=4"].doc_type == "tablo" and records["/f.pdf"].doc_type == "pdf"
    assert {r.status: r.n for r in crawler.counts(done.visits).collect()} == {200: 7, 404: 1}
    assert max(Counter(map(str, seen)).values()) == 1
    assert done.counters == {"requests": 8, "answered": 7, "failed": 1, "records": 8}
    pages = store.open_store(spark, str(tmp_path / "pages"), buckets=4)
    assert crawler.crawl_into(pages, done, "monday") == {"new": 8, "updated": 0, "unchanged": 0, "rejected": 0}
    assert crawler.crawl_into(pages, done, "tuesday") == {"new": 0, "updated": 0, "unchanged": 8, "rejected": 0}
    assert sum(crawler.crawl_into(pages, done, "tuesday").values()) == 0 and pages.read().count() == 8


def test_failed_tabs_leave_the_page(spark, site):
    base, _ = site
    records = {r.url[len(base) :]: r for r in run(spark, base, tabs="broken", depth=2).records.collect()}
    assert records["/?prsnl=7"].text == "Dr. Ad Soyad\nFakülte ve bölüm\n\nAkademik Görevler ve Öğrenim Bilgisi\ntab /broken/KisiselBilgiler of id=tok%3D"


def test_tabs_share_the_queue_of_their_host(spark, site):
    """One host, one task, one pause: requests and follow-ups come one after the other."""
    base, seen = site
    follow = "array<struct<label:string,url:string,field:string>>"
    rows = [(f"{base}/?prsnl=7", [("A", f"{base}/t/a", "id"), ("B", f"{base}/t/b", "key")]), (f"{base}/a", None), (f"{base}/?prsnl=8", [("A", f"{base}/t/a", "id")])]
    got = {r.url[len(base) :]: r.parts for r in source.fetched(spark.createDataFrame(rows, f"url string, follow {follow}").coalesce(1), pause="0.05", token=html.TOKEN).collect()}
    assert [(p.label, p.status) for p in got["/?prsnl=7"]] == [("A", 200), ("B", 200)] and got["/a"] is None and got["/?prsnl=8"] is None
    at = seen.index("/?prsnl=7")
    assert seen[at : at + 3] == ["/?prsnl=7", ("/t/a", "id=tok%3D"), ("/t/b", "key=tok%3D")]


def queue(pages, seeds, depth, most):
    """The same crawl by one queue: (visits in order, lists in order with the unit they came with)."""
    def key(u):
        return u.partition("#")[0]

    seen, todo, visits, lists, at = set(), [], [], [], 0
    for u in seeds:
        if key(u) not in seen:
            seen.add(key(u))
            todo.append((u, 0, None, None, []))
    while at < len(todo) and at < most:
        u, d, parent, unit, crumbs = todo[at]
        at += 1
        page = pages.get(key(u))
        visits.append((key(u), d, parent, 200 if page is not None else 404))
        if page is None:
            continue
        files, programmes, links, title = page
        unit = unit or (title if "/tr/Birim/" in u else None)
        crumbs = crumbs or (["Akademik", unit] if unit else [])
        for f in files:
            if key(f) not in seen:
                seen.add(key(f))
                todo.append((f, d, key(u), unit, crumbs))
        for n in programmes:
            if f"http://a.edu/list?id={n}" not in seen:
                seen.add(f"http://a.edu/list?id={n}")
                lists.append((n, unit, crumbs))
        if d < depth:
            for x in links:
                if key(x) not in seen:
                    seen.add(key(x))
                    todo.append((x, d + 1, key(u), unit, crumbs))
    return visits, lists


@pytest.mark.parametrize("seed", range(1))
def test_order_of_one_queue(spark, seed):
    """Random pages with files, lists and links that several pages share, and bounds that fall inside a round."""
    rng = random.Random(seed)
    names = [f"http://a.edu/{'tr/Birim/' if rng.random() < 0.3 else ''}p{rng.randrange(10**6)}" for _ in range(30)]
    pages, rows = {}, []
    for u in names[:25]:
        links, files = rng.choices(names, k=rng.randrange(6)), [f"http://a.edu/f{rng.randrange(8)}.pdf" for _ in range(rng.randrange(3))]
        links += ["http://a.edu/list?id=3"] if rng.random() < 0.1 else []
        programmes, title = [str(rng.randrange(6)) for _ in range(rng.randrange(2))], f"Title of {u[-4:]}"
        pages[u] = (list(dict.fromkeys(files)), programmes, list(dict.fromkeys(links)), title)
        body = f"<body><h1>{title}</h1><p>{TEXT}</p>" + "".join(f"<i onclick='derslistegetir({n})'></i>" for n in programmes) + "".join(f"<a href='{x}#{rng.randrange(3)}'></a>" for x in links) + "".join(f"<iframe src='{x}'></iframe>" for x in files) + "</body>"
        rows.append((u, "text/html", body.encode()))
    for k in range(8):
        pages[f"http://a.edu/f{k}.pdf"] = ([], [], [], None)
        rows.append((f"http://a.edu/f{k}.pdf", "application/pdf", b"text of a file that is long enough"))
    rows += [(f"http://a.edu/list?id={k}", "text/html", b"<body><table><tr><td>YAZ101</td><td>Bir ders adi burada</td></tr></table></body>") for k in range(6)]
    pages |= {f"http://a.edu/list?id={k}": ([], [], [], None) for k in range(6)}
    web = spark.createDataFrame(rows, "k string, content_type string, body binary").cache()
    fetch = lambda r: r.withColumn("k", F.regexp_replace("url", "#.*", "")).join(web, "k", "left").select("url", F.col("url").alias("final_url"), F.when(F.col("body").isNull(), 404).otherwise(200).alias("status"), "content_type", "body")
    seeds = [names[i] for i in (7, 3, 7, 11)]
    for depth, most in ((2, 1000), (3, 14)):
        frame = spark.createDataFrame([(u, i) for i, u in enumerate(seeds)], "url string, place int")
        done = crawler.crawl(frame, fetch, Scope(hosts=("a.edu",)), datetime.date(2026, 1, 1), "2026-01-01T00:00:00", lambda b: [b.decode()], None, "http://a.edu/list", CrawlParams(depth=depth, max_pages=most))
        visits, lists = queue(pages, seeds, depth, most)
        assert [(r.key, r.depth, r.from_key, r.status) for r in done.visits.orderBy("seq").collect()] == visits
        told = {r.url.split("=")[1]: (r.unit, r.breadcrumb) for r in done.records.filter("doc_type = 'tablo' and title like '%Ders Listesi%'").collect()}
        assert told == {n: (unit, crumbs) for n, unit, crumbs in lists}


def test_bounds(spark, site):
    base, seen = site
    few = run(spark, base, depth=2, max_pages=3)
    assert sorted(r.key[len(base) :] for r in few.visits.collect()) == ["/", "/b", "/f.pdf"]  # in the order of places
    none = run(spark, base, max_pages=0)
    assert none.records.count() == 0 and none.visits.count() == 0
    assert none.records.columns == few.records.columns


def test_requests(spark, site):
    base, seen = site
    rows = {r.url[len(base) :]: r for r in source.fetched(spark.createDataFrame([(f"{base}/a", None), (f"{base}/no", None), (f"{base}/tab?tab=9", "x=1"), (None, None)], "url string, data string"), pause="0").collect()}
    assert {k: r.status for k, r in rows.items()} == {"/a": 200, "/no": 404, "/tab?tab=9": 200}
    assert rows["/no"].body is None and b"tab /tab?tab=9 of x=1" in rows["/tab?tab=9"].body and ("/tab?tab=9", "x=1") in seen
    closed = source.fetched(spark.createDataFrame([("http://127.0.0.1:9/",)], "url string"), pause="0", attempts="1").select(F.col("status"), "body").first()
    assert tuple(closed) == (None, None)
