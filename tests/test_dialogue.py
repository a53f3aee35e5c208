import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from lexmill.functions.text import normalize_tr
from lexmill.operators import answers, evaluation, questions


def one(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_redirects(spark):
    said = ["Notlarımı nereden görürüm", "Kütüphane  kaçta açılıyor", "DERS   KAYDI ne zaman", "Kürşad kimdir", "anot", "", None]
    assert one(spark, said, questions.redirect) == ["student_system", "library", "student_system", "courses", None, None, None]


def test_follow_ups(spark):
    said = ["peki bölüm başkanı kim acaba bilen var mı", "onun hangi dersleri verdiğini bilen biri var mı", "bölüm başkanı kim", "bölüm başkanı kim ve hangi odada oturuyor", "yatay geçiş için hangi belgeler ne zaman istenir"]
    assert one(spark, said, questions.is_follow_up) == [True, True, True, False, True]
    assert one(spark, ["peki ya o zaman bölüm başkanı kim", "Bir de AYRICA kim", "peki", "", None], questions.without_connectives) == ["bölüm başkanı kim", "kim", "peki", "", None]


def test_rewrite(spark):
    rows = [
        (1, 0, "system", "x"), (1, 1, "user", "Yazılım Mühendisliğinde kim var acaba orada şimdi"), (1, 2, "assistant", "ok"), (1, 3, "user", "peki başkanı kim"), (1, 4, "assistant", "a"), (1, 5, "assistant", "b"),
        (1, 6, "user", "peki Mimarlık nasıl"), (1, 7, "user", "peki"), (2, 0, "assistant", "x"), (2, 1, "user", "kim"), (2, 2, "user", None),
    ]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    units = spark.createDataFrame([("Yazılım Mühendisliği",), ("Yazılım",), ("Mimarlık",), (None,)], "unit string")
    turns = questions.turns(conv)
    assert [r.answer for r in turns.filter("conv_id = 1").orderBy("turn").collect()] == ["ok", "a", None, None]
    got = questions.rewrite(turns, units).orderBy("conv_id", "turn").collect()
    assert [r.search_question for r in got] == ["Yazılım Mühendisliğinde kim var acaba orada şimdi", "Yazılım Mühendisliği başkanı kim", "Mimarlık nasıl", "Mimarlık peki", "kim", None]
    assert got[0].topic is None
    assert questions.rewrite(turns.limit(0), units).count() == 0


def test_readings(spark):
    assert one(spark, ["telefon numarası", "E-posta adresi", "nerede bu", "otel", "kim"], questions.intent) == ["phone", "email", "address", "phone", None]
    assert one(spark, ["Ahmet Can kimdir", "Ahmet Can telefonu kim", "hava nasıl"], questions.asks_identity) == [True, False, False]
    assert one(spark, ["Beyza Kızıldağ kimdir", "ne"], questions.name_parts) == [["beyza", "kizildag"], []]
    assert one(spark, ["Beyza Kızıldağ", "beyza kızıldağ kimdir", "bölüm başkanı kim", "kim"], questions.looks_like_person) == [True, True, False, False]


def test_units_by_automaton(spark):
    """The longest name that stands in a text, ties to the first; time does not grow with the number of units."""
    rng = random.Random(2)
    names = ["ab", "abc", "bcd", "xyz abc", "b", "Ç", "zz ab", "ab zz", " ", "", None] + ["".join(rng.choices("abcxyz ", k=rng.randrange(1, 6))) for _ in range(40)]
    texts = ["".join(rng.choices("abcxyz ", k=rng.randrange(30))) for _ in range(200)] + [None, ""]
    known = sorted({n for n in names if n and n.strip()}, key=lambda n: (-len(n), n))
    normal = {r.unit: r.n for r in spark.createDataFrame([(n,) for n in known], "unit string").select("unit", normalize_tr(F.col("unit")).alias("n")).collect()}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    find = questions.unit_finder(spark.createDataFrame([(n,) for n in names], "unit string"))
    got = {r.i: r.u for r in df.select("i", find(F.col("t")).alias("u")).collect()}
    assert got == {i: next((n for n in known if t and normal[n] and normal[n] in t), None) for i, t in enumerate(texts)}
    assert df.select(questions.unit_finder(spark.createDataFrame([], "unit string"))(F.col("t")).alias("u")).filter("u is not null").count() == 0
    took = []
    for n in (100, 50_000):
        find = questions.unit_finder(spark.range(n).select(F.concat(F.lit("faculty of number "), F.col("id").cast("string")).alias("unit")))
        many = spark.range(20_000).repartition(2).select(F.concat(F.lit("where is the faculty of number "), (F.col("id") % 90).cast("string"), F.lit(" please")).alias("t"))
        many.select(find(F.col("t")).alias("u")).count()
        began = time.time()
        assert many.select(find(F.col("t")).alias("u")).filter("u is not null").count() == 20_000
        took.append(time.time() - began)
    assert took[1] < 3 * took[0] + 5, took


def test_staff_names(spark):
    chunks = spark.createDataFrame([("personel", "Birim — Arş. Gör. Beyza KIZILDAĞ", "Doç. Dr. Hakan YILMAZ | oda\nProf. Dr. Tek\nmetin"), ("sayfa", "Doç. Dr. Baş KA", "x"), ("personel", None, None)], "doc_type string, title string, text string")
    names = questions.staff_names(chunks)
    assert sorted(r.name for r in names.collect()) == [["beyza", "kizildag"], ["hakan", "yilmaz"]]
    asked = spark.createDataFrame([(1, "Hakan YILMAZ kimdir"), (2, "hakan kim"), (3, None)], "query_id long, text string")
    assert {r.query_id: r.named for r in questions.names_staff(asked, names).collect()} == {1: True, 2: False, 3: False}


def test_fields(spark):
    said = ["x\nTelefon (Sekreter): 0332 205  1425\n", "Telefon:\n\n0 (332) 205 14 29", "Telefon: yok\n0332 205 1425", "yok", None]
    assert one(spark, said, answers.phone) == ["0332 205 1425", "0 (332) 205 14 29", "0332 205 1425", None, None]
    assert one(spark, ["a b.c-d@ab.edu.tr.", "a@b.net", ""], answers.email) == ["b.c-d@ab.edu.tr", None, None]
    assert one(spark, ["Adres: Kısa", "ADRES\nUzun bir adres satırı 5"], answers.address) == [None, "Uzun bir adres satırı 5"]
    assert one(spark, ["YAZ102 kaç kredi", "yaz102", "BBF 101 mi"], answers.course_code) == ["YAZ102", None, "BBF 101"]
    assert tuple(one(spark, ["Kod | x\nYAZ 102 | Algoritma | 6 | Dr. X"], lambda c: answers.course_row(c, F.lit("YAZ102")))[0]) == ("Algoritma", "6", "Dr. X")


RESULTS = "query_id long, rank int, title string, unit string, text string, url string, published_at string"


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        (1, 1, "Eski liste", "U", "Dr. Öğr. Üyesi İsmail KOÇ", "u1", None), (1, 2, "Akademik Personel", "Yazılım", "Doç. Dr. İsmail KOÇ | oda", "u2", None),
        (2, 1, "Birim — Arş. Gör. Beyza KIZILDAĞ", None, "metin", "u3", None), (3, 1, "Dersler", "U", "YAZ102 | Algoritma | 6 |", "u4", None),
        (4, 1, "Haber", "A", "0332 111 2222", "u5", None), (4, 2, "İletişim", "B", "Telefon: 0332 333 4444", "u6", None), (5, 1, "X", "U", "bir iki", "u7", "2026-01-02"), (5, 2, "Y", "U", "üç", "u7", None),
    ]
    return spark.createDataFrame(rows, RESULTS)


QUERIES = [(1, "İsmail Koç kimdir", True), (2, "Beyza Kızıldağ", True), (3, "YAZ102 kaç kredi", False), (4, "bölüm telefonu", None), (5, "bir şey anlat", False), (6, "Ali Veli kimdir", False), (7, "futbol", False), (8, "kütüphane nerede", False)]


def test_direct(spark, results):
    q = spark.createDataFrame(QUERIES, "query_id long, text string, named boolean")
    got = {r.query_id: (r.answer, r.rank) for r in answers.direct_answers(results, q).collect()}
    assert got == {1: ("Doç. Dr. İsmail KOÇ — Yazılım akademik kadrosunda.", 2), 2: ("Arş. Gör. Beyza KIZILDAĞ — site akademik kadrosunda.", 1), 3: ("YAZ102 dersinin adı Algoritma. AKTS kredisi 6.", 1), 4: ("B telefon numarası: 0332 333 4444", 2)}


def test_routes(spark, results):
    q = spark.createDataFrame(QUERIES, "query_id long, text string, named boolean").withColumn("search_text", F.col("text"))
    gate = spark.createDataFrame([(i, 1.005, 0.5, i == 5) for i in range(1, 9)], "query_id long, bm25_max double, cosine_max double, in_scope boolean")
    told = answers.route(q, results, gate, datetime.date(2026, 1, 5), redirects=questions.redirect(F.col("text")))
    got = {r.query_id: (r.route, r.answer, [s.url for s in r.sources]) for r in told.collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "direct", 2: "direct", 3: "direct", 4: "direct", 5: "answered", 6: "not_recorded", 7: "out_of_scope", 8: "redirect"}
    assert got[5] == ("answered", "[1] X (2026-01-02 tarihli)\nbir iki\n[2] Y\nüç", ["u7"]) and got[1][2] == ["u2"] and got[8][1:] == ("library", [])
    log = answers.unanswered(told, q, gate, "2026-01-05T00:00:00")
    assert sorted((r.question, r.reason, r.bm25_max) for r in log.collect()) == [("Ali Veli kimdir", "not_recorded", 1.0), ("futbol", "out_of_scope", 1.0)]
    silent = answers.route(q.filter("query_id = 5"), results, gate, datetime.date(2026, 1, 5), lambda prompts: ["BİLGİ_YOK"] * len(prompts)).first()
    assert (silent.route, silent.answer, silent.sources) == ("unknown", None, [])


def test_failures_and_texts(spark, results):
    q = spark.createDataFrame([(5, "yemek listesi", "yemek listesi", False), (6, "zzz nedir acaba", "zzz nedir acaba", False)], "query_id long, text string, search_text string, named boolean")
    gate = spark.createDataFrame([(5, True), (6, False)], "query_id long, in_scope boolean").withColumns({"bm25_max": F.lit(1.0), "cosine_max": F.lit(0.5)})

    def broken(prompts):
        raise TimeoutError

    told = answers.route(q, results, gate, datetime.date(2026, 1, 5), broken, texts={"failed": "later", "out_of_scope": "not here"})
    assert {r.query_id: (r.route, r.answer, r.sources) for r in told.collect()} == {5: ("failed", "later", []), 6: ("out_of_scope", "not here", [])}
    assert {r.reason for r in answers.unanswered(told, q, gate, "t").collect()} == {"failed", "out_of_scope"}

    def fussy(prompts):
        if "bad" in prompts:
            raise ValueError
        return [p.upper() for p in prompts]

    rows = answers.generate(spark.createDataFrame([("a",), ("bad",), (None,), ("c",)], "p string").coalesce(1), "p", "said", fussy).collect()
    assert [r.said for r in rows] == ["A", None, None, "C"]


def test_served_model():
    """A system message, requests side by side, refusals asked again, failures that cost no other prompt its answer."""
    import http.server
    import json
    import threading

    seen, now, most = [], 0, 0
    lock = threading.Lock()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            nonlocal now, most
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            prompt = asked["messages"][-1]["content"]
            with lock:
                seen.append(prompt)
                now, again = now + 1, seen.count(prompt)
                most = max(most, now)
            time.sleep(0.1)
            with lock:
                now -= 1
            status = 503 if prompt == "busy" and again < 3 else 400 if prompt == "bad" else 200
            told = {"message": {"content": f" {asked['model']}:{prompt}:{asked['options']['seed']}:{len(asked['messages'])} "}} if prompt != "odd" else ["no message"]
            body = json.dumps(told).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/"
    model = answers.ServedModel(url, "m", timeout=5, wait=0.01, at_once=3, seed=3)
    assert model(["x", "busy", "bad", "odd", *"abcd"]) == ["m:x:3:2", "m:busy:3:2", None, None, *[f"m:{c}:3:2" for c in "abcd"]]
    assert seen.count("busy") == 3 and seen.count("bad") == 1 and 1 < most <= 3
    assert answers.MARKER in json.loads(model.request("x"))["messages"][0]["content"] and answers.MARKER.lower() in answers.UNKNOWN
    assert answers.ServedModel(url, "m", system=None, seed=1)(["y"]) == ["m:y:1:1"]
    began = time.time()
    assert answers.ServedModel("http://127.0.0.1:9/", "m", attempts=100, wait=0.05, deadline=0.5)(["z"]) == [None] and time.time() - began < 3
    server.shutdown()


def test_context(spark):
    text = lambda n: " ".join(["w"] * n)
    rows = [(1, 1, text(60)), (1, 2, text(60)), (1, 3, text(5)), (2, 1, text(90)), (2, 2, text(20)), (3, 1, None), (3, 2, text(100)), (3, 3, "")]
    packed = answers.pack_context(spark.createDataFrame(rows, "query_id long, rank int, text string"), 100, 40)
    assert sorted((r.query_id, r.rank, r.words) for r in packed.collect()) == [(1, 1, 60), (1, 2, 40), (2, 1, 90), (3, 1, 0), (3, 2, 100), (3, 3, 0)]
    assert packed.filter("query_id = 1 and rank = 2").first().text == text(40) + " ..."


def test_answer_quality(spark):
    gold = spark.createDataFrame([(1, "Ankara"), (2, "x"), (3, None)], "query_id long, expected string")
    said = spark.createDataFrame([(1, "direct", "ANKARA'da", 1.0), (2, "answered", None, 3.0)], "query_id long, route string, answer string, seconds double")
    assert tuple(evaluation.answer_quality(said, gold).first()) == (3, 0.333333, 1, 2.0)
