import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.operators import chunking
from lexmill.schema import ChunkParams

SMALL = ChunkParams(window=8, overlap=3)


def run(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("text"))).collect()]


def packed(text, p):
    """The windows of a text, in plain Python."""
    pieces = []
    for line in (s for s in text.split("\n") if s.strip()):
        w = line.split()
        pieces += [line] if len(w) <= p.window else [" ".join(w[i : i + p.window]) for i in range(0, len(w), p.window - p.overlap)]
    out, held, n = [], [], 0
    for piece in pieces:
        if held and n + len(piece.split()) > p.window:
            out.append("\n".join(held))
            tail = " ".join(held).split()[-p.overlap :]
            held, n = [" ".join(tail)], len(tail)
        held.append(piece)
        n += len(piece.split())
    return out + (["\n".join(held)] if held else [])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=30).map(" ".join), max_size=8).map("\n".join), min_size=1, max_size=20))
def test_windows_like_python(spark, texts):
    assert run(spark, texts, lambda c: chunking.windows(c, SMALL)) == [packed(t, SMALL) for t in texts]


def test_windows_edges(spark):
    assert run(spark, ["", " \n ", None], chunking.windows) == [[], [], None]
    long = " ".join(str(i) for i in range(650))
    assert [len(t.split()) for t in run(spark, [long], lambda c: chunking.strides(F.split(c, " ")))[0]] == [380, 330, 10]
    assert run(spark, [long], chunking.windows) == [packed(long, ChunkParams())]


def test_spacing(spark):
    said = ["G ö r e v  U n v a n ı :", "A B C", "a b c d e bbb ccc ddd", "a b c d e bbb ccc dd\nx", None]
    assert run(spark, said, chunking.repair_spacing) == ["Görev Unvanı:", "A B C", "abcdebbbcccddd", "abcdebbbcccdd\nx", None]
    assert run(spark, ["a b c d bbb ccc ddd eee"], chunking.repair_spacing) == ["a b c d bbb ccc ddd eee"]


def test_job_forms(spark):
    assert run(spark, ["GÖREV UNVANI x BAĞLI ALT UNVANLAR", "görev unvanı", ""], chunking.is_job_form) == [True, False, False]


PAGES = "url string, title string, unit string, doc_type string, published_at string, text string"


def chunks(spark, *rows, p=ChunkParams()):
    df = spark.createDataFrame([("u", *r) for r in rows], PAGES)
    return [(r.n, r.text) for r in chunking.chunk_pages(df, p).orderBy("n").collect()]


def test_kinds(spark):
    p = ChunkParams(window=10, overlap=3, min_words=2)
    terms = "giriş satırı burada\nGÜZ YARIYILI\nMat | 5 | x\nFiz | 6 | y\nBahar Yarıyılı\n3. YARIYIL\nKim | 7 | z"
    assert chunks(spark, ("T", "U", "tablo", None, terms), p=p) == [(0, "T\ngiriş satırı burada"), (1, "T — GÜZ YARIYILI\nMat | 5 | x\nFiz | 6 | y"), (2, "T — 3. YARIYIL\nKim | 7 | z")]
    assert chunks(spark, ("T", "U", "tablo", None, "GÜZ YARIYILI\nbir iki üç"), p=p) == [(0, "GÜZ YARIYILI\nbir iki üç")]
    news = "Anasayfa\n>\nDuyuru  Detay\nBaşlık  Burada\nmetin bir iki üç"
    assert chunks(spark, ("başlık burada", None, "duyuru", "2026-01-02", news), p=p) == [(0, "[2026-01-02] Başlık  Burada\nmetin bir iki üç")]
    assert chunks(spark, ("yok", None, "duyuru", None, "Anasayfa\n>\ngövde metni bir iki"), p=p) == [(0, "gövde metni bir iki")]
    staff = "bir iki üç dört beş altı\nyedi sekiz dokuz on on_bir"
    assert chunks(spark, ("Ad", None, "personel", None, staff), p=p) == [(0, "Ad\nbir iki üç dört beş altı"), (1, "Ad\ndört beş altı\nyedi sekiz dokuz on on_bir")]
    assert chunks(spark, ("Ad", None, "personel", None, "Doç. Dr. Emine BAŞ")) == [(0, "Doç. Dr. Emine BAŞ")]


def test_filters(spark):
    assert chunks(spark, ("T", "U", "sayfa", None, "T\nU\n© Copyright x\nbir iki üç dört beş altı yedi")) == []
    assert chunks(spark, ("T", "U", "sayfa", None, "T\nSayfa 1 / 2\nbir iki üç dört beş altı yedi sekiz")) == [(0, "T\nbir iki üç dört beş altı yedi sekiz")]
    assert chunks(spark, (None, None, "sayfa", None, None), ("T", None, "sayfa", None, "Program Seçiniz")) == []
    df = spark.createDataFrame([("u", "T", None, "sayfa", None, "görev unvanı bağlı alt unvanlar " + "xy " * 400)], PAGES)
    rows = chunking.chunk_pages(df).orderBy("n").collect()
    assert len(rows) == 2 and [r.chunk_id for r in rows] == [hashlib.sha1(f"u#{i}".encode()).hexdigest()[:16] for i in range(len(rows))] and all(r.job_form for r in rows)
    assert chunking.profile(chunking.chunk_pages(df)).count() == 2
