"""From responses to answers."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from lexmill.operators import assistant, chunking, crawl, dense, ingest, questions
from lexmill.schema import SearchParams
from lexmill.sources import index, report

UNIT = """<body><main id="mainContent"><h1>Yazılım Mühendisliği</h1><a href="/tr/Birim/Personel">Akademik Personel</a><a href="/tr/x.pdf">Plan</a>
<p onclick="derslistegetir(7)">Bölümümüz iki bin on bir yılında kuruldu ve öğrenci almaya devam ediyor.</p><iframe src="/f/takvim.pdf"></iframe></main></body>"""
STAFF = "<body><h1>Liste</h1><p>Doç. Dr. Hakan YILMAZ</p><p>Arş. Gör. Beyza KIZILDAĞ</p></body>"
NEWS = "<body><h1>Kayıt</h1><p>Kayıtlar 5 Ocak günü başlıyor, belgeler öğrenci işlerine teslim edilecek.</p></body>"
LIST = "<body><table><tr><td>YAZ102</td><td>Algoritma ve Programlama</td><td>6</td><td>Doç. Dr. Hakan YILMAZ</td></tr></table></body>"
FETCHED = "url string, content_type string, body binary, menu string, unit string, breadcrumb array<string>, depth int"
ROWS = [
    ("http://a.edu/tr/Birim/1", "text/html", UNIT.encode(), None, None, [], 0),
    ("http://a.edu/tr/Birim/AkademikPersonel", "text/html", STAFF.encode(), "Akademik Personel", "Yazılım Mühendisliği", ["Akademik"], 1),
    ("http://a.edu/tr/DuyuruDetay/3", "text/html", NEWS.encode(), None, None, None, 2),
    ("http://a.edu/f/takvim.pdf", "application/pdf", b"Akademik takvim: derslerin baslamasi 15 Eylul", "Takvim", "U", [], 0),
    ("http://a.edu/bos", "image/png", b"", None, None, None, 0),
]


def encoder(texts):
    """Letters counted: enough to tell texts apart."""
    return np.array([[1e-3 + t.lower().count(c) for c in "abcdefghijklmnoprstuvyz"] for t in texts])


def test_from_responses_to_answers(spark, tmp_path):
    fetched = spark.createDataFrame(ROWS, FETCHED)
    today = datetime.date(2026, 1, 10)
    rows = ingest.parsed(fetched)
    records = ingest.html_records(rows, today, "2026-01-10T00:00:00").unionByName(ingest.pdf_records(fetched, lambda b: [b.decode()], "2026-01-10T00:00:00"))
    courses = spark.createDataFrame([("http://a.edu/list?id=7", "text/html", LIST.encode(), "Ders Listesi (AKTS)", "Yazılım Mühendisliği", [], 0)], FETCHED)
    records = records.unionByName(ingest.course_records(courses, "2026-01-10T00:00:00"))
    got = {r.url.rsplit("/", 1)[-1]: (r.title, r.doc_type, r.unit, r.published_at) for r in records.collect()}
    assert got == {
        "1": ("Yazılım Mühendisliği", "sayfa", "Yazılım Mühendisliği", None),
        "AkademikPersonel": ("Yazılım Mühendisliği — Akademik Personel", "personel", "Yazılım Mühendisliği", None),
        "3": ("Kayıt", "duyuru", None, "2026-01-05"),
        "takvim.pdf": ("Takvim (PDF)", "pdf", "U", None),
        "list?id=7": ("Yazılım Mühendisliği — Ders Listesi (AKTS)", "tablo", "Yazılım Mühendisliği", None),
    }
    offered = {(r.url, r.menu, r.depth) for r in ingest.offers(rows, crawl.CrawlParams(depth=1)).collect()}
    assert offered == {("http://a.edu/f/takvim.pdf", "Yazılım Mühendisliği", 0), ("http://a.edu/tr/Birim/Personel", "Akademik Personel", 1), ("http://a.edu/tr/x.pdf", "Plan", 1)}
    assert [(r.url, r.menu, r.unit) for r in ingest.course_lists(rows, "http://a.edu/list").collect()] == [("http://a.edu/list?id=7", "Ders Listesi (AKTS)", "Yazılım Mühendisliği")]

    chunks = dense.encode(chunking.chunk_pages(records).withColumn("t", dense.embedding_text()), "t", encoder).drop("t", "n")
    index.save(index.with_positions(chunks), str(tmp_path / "index"), "letters", "test", datetime.datetime(2026, 1, 10))
    chunks, words, vectors = index.load(spark, str(tmp_path / "index"))
    turns = [(1, 1, 0, "Hakan Yılmaz kimdir", "x"), (2, 2, 0, "kütüphane nerede", "x"), (3, 3, 0, "YAZ102 dersi Yazılım Mühendisliği bölümünde kaç kredi acaba", "x"), (4, 3, 1, "peki kayıtlar ne zaman başlıyor belgeler nereye", "x"), (5, 4, 0, "zzz qqq", "x")]
    asked = spark.createDataFrame(turns, "query_id long, conv_id long, turn long, question string, answer string")
    prepared = dense.encode(assistant.prepare(asked, chunks).withColumn("t", dense.query_text("search_text")), "t", encoder, "vector").drop("t")
    p = SearchParams(gate_bm25=0.5, gate_cosine=0.1, gate_cosine_alone=2.0, gate_bm25_alone=50.0)
    routed, gate = assistant.respond(prepared, chunks, words, vectors, today, redirects=questions.redirect(F.col("text")), p=p)
    got = {r.query_id: (r.route, r.answer) for r in routed.collect()}
    assert got[1] == ("direct", "Doç. Dr. Hakan YILMAZ — Yazılım Mühendisliği akademik kadrosunda.")
    assert got[2] == ("redirect", "library")
    assert got[3][0] == "direct" and "Algoritma ve Programlama" in got[3][1]
    assert got[4][0] == "answered" and got[5][0] == "out_of_scope"
    assert {r.query_id: r.search_text for r in prepared.collect()}[4] == "Yazılım Mühendisliği kayıtlar ne zaman başlıyor belgeler nereye"
    assert gate.count() == 5


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "i int, t string")
    assert report.markdown(df) == "| i | t |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |"
    report.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
