import datetime
import json

from pyspark.sql import functions as F

from lexmill.functions import dates, urls
from lexmill.operators import pages
from lexmill.schema import PAGE_FIELDS, PAGES
from lexmill.sources import jsonl

TODAY = datetime.date(2026, 3, 1)


def one(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_dates(spark):
    said = ["x 12 Ağustos 2026", "12.08.2026", "5 NİSAN 2025 ve 1.1.2020", "30\nOcak", "30 / Ocak", "31 Şubat", "20 Nisan", "99.99.2026", "", None, "x" * 300 + " 3 Ocak"]
    want = ["2026-08-12", "2026-08-12", "2025-04-05", "2026-01-30", None, None, "2025-04-20", None, None, None, None]
    assert one(spark, said, lambda c: dates.published_at(c, TODAY, True)) == want
    assert one(spark, ["30 Ocak"], lambda c: dates.published_at(c, TODAY)) == [None]


def test_urls(spark):
    s = urls.Scope(hosts=("a.edu",), denied_hosts=("b.a.edu",))
    said = ["http://A.edu/x/?q=a+b==#f", "https://a.edu", "ftp://a.edu/x", "https://b.a.edu/", "https://a.edu/x.JPG", "https://a.edu/?ay=3", "https://a.edu/?id=YmFyay=", "https://a.edu/en/x", "a b", None]
    assert one(spark, said, urls.identity)[:2] == ["http://a.edu/x?q=a+b==", "https://a.edu/"]
    assert one(spark, said, lambda c: urls.in_scope(c, s)) == [True, True, False, False, False, False, True, False, False, False]
    assert one(spark, ["http://a/x.PDF?y", "http://a/x", None], urls.is_pdf) == [True, False, False]


def test_kind(spark):
    bars = "\n".join(["a | b"] * 4 + ["c", "d"])
    df = spark.createDataFrame([("http://x/DuyuruDetay/1", "t"), ("http://x?prsnl=a", ""), ("http://x/y", bars), ("http://x", "a|b\na|b"), (None, None)], "url string, text string")
    assert [r[0] for r in df.select(pages.doc_type(F.col("url"), F.col("text"))).collect()] == ["duyuru", "personel", "tablo", "sayfa", "sayfa"]
    assert df.select(pages.doc_type(F.col("url"), F.col("text"), True)).first()[0] == "pdf"


def test_response_kinds(spark):
    df = spark.createDataFrame([("http://x/a.pdf?b", "text/plain", b""), ("http://x", "text/HTML; x", "ş".encode()), ("http://x", None, b"")], "url string, content_type string, body binary")
    assert [(r.kind, r.html) for r in pages.classify_response(df).collect()] == [("pdf", None), ("html", "ş"), (None, None)]


def raw(**change):
    row = {"url": "http://x/a", "title": " T ", "breadcrumb": ["a", ""], "unit": "U", "doc_type": "sayfa", "text": " 12345678901234567890 ", "published_at": None}
    return tuple((row | change)[k] for k in row)


def test_records(spark):
    schema = "url string, title string, breadcrumb array<string>, unit string, doc_type string, text string, published_at string"
    df = spark.createDataFrame([raw(), raw(text="short"), raw(text=None), raw(doc_type="duyuru"), raw(doc_type="duyuru", published_at="2026-01-02"), raw(published_at="2026-01-02"), raw(title=None, unit=None, url="http://x/last/"), raw(doc_type="odd", breadcrumb=None)], schema)
    got = pages.records(df, "2026-01-01T00:00:00").collect()
    assert [(r.title, r.doc_type, r.published_at, r.breadcrumb) for r in got] == [("T", "sayfa", None, ["a"]), ("T", "sayfa", None, ["a"]), ("T", "duyuru", "2026-01-02", ["a"]), ("T", "sayfa", None, ["a"]), ("last", "sayfa", None, ["a"]), ("T", "sayfa", None, [])]
    assert all(not e for (e,) in pages.validate(pages.records(df, "2026-01-01T00:00:00")).select("errors").collect())
    assert pages.records(df.limit(0), "T").count() == 0


def test_titles(spark):
    df = spark.createDataFrame([("http://x/tr/Birim/1", "H", None, None, []), ("http://x/1", "H", "M", "U", ["a", "b", "c", "d"]), ("http://x/1", "H", "", None, None)], "url string, heading string, menu string, unit string, breadcrumb array<string>")
    got = pages.title_and_unit(df, "/tr/Birim/").withColumn("child", pages.child_breadcrumb(F.col("breadcrumb"), F.col("menu"))).collect()
    assert [(r.title, r.unit, r.breadcrumb, r.child) for r in got] == [("H", "H", ["Akademik", "H"], ["Akademik", "H"]), ("U — M", "U", ["a", "b", "c", "d"], ["b", "c", "d", "M"]), ("H", None, [], [])]


def line(**change):
    row = {"url": "http://x/a", "title": "t", "breadcrumb": [], "unit": None, "doc_type": "sayfa", "text": "x" * 20, "published_at": None, "fetched_at": "2026-01-01T00:00:00", "content_hash": "a" * 40} | change
    return json.dumps({k: v for k, v in row.items() if v != "absent"})


def test_validate_lines(spark, tmp_path):
    cases = [
        (line(), []),
        (line(url="http://x/b", title="absent", text="absent"), ["missing: text, title"]),
        (line(url="http://x/c", more=1), ["not in the schema: more"]),
        (line(url="ftp://x"), ["url"]),
        (line(url="http://x/%2B"), ["url encoded again"]),
        (line(url="http://x/ b"), ["url with space"]),
        (line(url="http://x/d", title=" "), ["title empty"]),
        (line(url="http://x/e", breadcrumb="x"), ["breadcrumb not a list"]),
        (line(url="http://x/f", unit=5), ["unit not a string"]),
        (line(url="http://x/g", doc_type="z"), ["doc_type unknown"]),
        (line(url="http://x/h", text="x" * 19), ["text too short"]),
        (line(url="http://x/i", published_at="2026-99-99"), ["published_at not a date"]),
        (line(url="http://x/j", doc_type="duyuru"), ["published_at missing"]),
        (line(url="http://x/k", fetched_at="2026"), ["fetched_at not a time"]),
        (line(url="http://x/l", content_hash="a" * 39), ["content_hash not sha1"]),
        ("{broken", ["not a JSON object"]),
        ("[1]", ["not a JSON object"]),
        ("  ", None),
        (line(), ["url repeated from line 1"]),
    ]
    path = tmp_path / "p.jsonl"
    path.write_text("\n".join(c for c, _ in cases) + "\n")
    lines = jsonl.read_lines(spark, str(path))
    assert [r.line for r in lines.orderBy("line").collect()] == list(range(1, len(cases) + 1))
    checked = pages.validate_lines(lines)
    assert [(r.line, r.errors) for r in checked.orderBy("line").collect()] == [(i, e) for i, (_, e) in enumerate(cases, 1) if e is not None]
    assert tuple(pages.counts(checked).first()) == (18, 1, 17)
    assert pages.error_report(checked, 2).count() == 2
    assert [tuple(r) for r in pages.type_counts(checked).collect()] == [("sayfa", 1, 1)]
    assert [tuple(r) for r in pages.unit_counts(checked).collect()] == [("(general)", 1, 1)]
    assert {r[0] for r in pages.missing_types(checked).collect()} == {"personel", "tablo", "pdf", "duyuru"}


def test_upsert(spark):
    schema = "url string, fetched_at string, content_hash string, v int"
    old = spark.createDataFrame([("a", "1", "h", 0), ("b", "1", "h", 0), ("c", "1", "h", 0)], schema)
    new = spark.createDataFrame([("a", "2", "h", 1), ("b", "2", "g", 1), ("b", "3", "k", 2), ("d", "2", "h", 1), (None, "2", "h", 1)], schema)
    got = {r.url: (r.status, r.fetched_at) for r in pages.upsert(old, new, version="v").collect()}
    assert got == {"a": ("unchanged", "1"), "b": ("updated", "3"), "c": ("kept", "1"), "d": ("new", "2")}
    assert pages.upsert(old.limit(0), new.limit(0)).count() == 0


def test_sample(spark):
    data = [(i, "abc"[i % 3] if i % 7 else None, "x" * (i * 37 % 101)) for i in range(400)]
    df = spark.createDataFrame(data, "i long, t string, text string")
    got = sorted(r.i for r in pages.stratified_sample(df, 50, "t", "i", F.length("text")).collect())
    groups: dict = {}
    for i, t, x in data:
        groups.setdefault(t, []).append((len(x), i))
    base = {t: min(2, len(g)) for t, g in groups.items()}
    rest, spare = 50 - sum(base.values()), sum(len(g) - base[t] for t, g in groups.items())
    want = []
    for t, g in groups.items():
        n, quota = len(g), min(len(g), base[t] + round(rest * (len(g) - base[t]) / spare))
        g.sort()
        want += [g[round(i * (n - 1) / (quota - 1))][1] for i in range(quota)]
    assert got == sorted(want)
    assert pages.stratified_sample(df, 1000, "t", "i", F.length("text")).count() == 400
    assert pages.stratified_sample(df.limit(0), 10, "t", "i", F.length("text")).count() == 0


def test_jsonl_round_trip(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text("\n".join([line(title="old"), "{bad", line(url="http://x/b"), line(title="new")]))
    got = jsonl.read_lenient(spark, str(path)).orderBy("pos").collect()
    assert [(r.url, r.title, r.pos) for r in got] == [("http://x/a", "new", 1), ("http://x/b", "t", 3)]
    out = str(tmp_path / "out")
    assert jsonl.write(spark.createDataFrame([tuple(json.loads(line())[k] for k in PAGE_FIELDS)], PAGES), out) == 1
    assert jsonl.read_strict(spark, out).count() == 1
