import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import dense, evaluation, hybrid, regions, sparse
from lexmill.schema import SearchParams
from lexmill.sources import index as store

DOCS = [(1, "kedi köpek kedi"), (2, "köpek"), (3, "at kuş kuş kuş köpek"), (4, ""), (5, None), (6, "köpek köpek fil"), (7, "köpek aslan")]


def brute(docs, query):
    bags = {i: Counter((t or "").replace("ö", "o").replace("ş", "s").split()) for i, t in docs}
    n, avg = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(t for b in bags.values() for t in b)
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if x < 0 else x for t, x in idf.items()}
    out = {}
    for i, b in bags.items():
        s = sum(idf[t] * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * sum(b.values()) / avg)) for t in query if b[t])
        if any(b[t] for t in query):
            out[i] = round(s, 6)
    return out


@pytest.fixture(scope="module")
def index(spark):
    return sparse.build(spark.createDataFrame(DOCS, "doc_id long, text string"), "doc_id", ("text",))


def test_bm25(spark, index):
    queries = spark.createDataFrame([(1, ["kopek", "kedi", "kedi"]), (2, ["yok"]), (3, []), (4, ["kus"])], "query_id long, tokens array<string>")
    got: dict = {}
    for r in sparse.score(index, queries).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = pytest.approx(r.score, abs=2e-6)
    assert got == {1: brute(DOCS, ["kopek", "kedi", "kedi"]), 4: brute(DOCS, ["kus"])}


def test_fill_and_ties(spark, index):
    queries = spark.createDataFrame([(1, ["kus"]), (2, [])], "query_id long, tokens array<string>")
    filled = sparse.fill(sparse.topk(sparse.score(index, queries), 3), queries, index.docs, 3)
    assert sorted((r.query_id, r.rank, r.doc_id) for r in filled.collect()) == [(1, 1, 3), (1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 2, 2), (2, 3, 3)]


def test_bounds_leave_the_best(spark):
    """Rows of the pruned search are those of the whole one, ties included, and rare words read few postings."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(200)]
    weights = 1 / np.arange(1, 201)
    docs = [(int(i) * 7 - 900, " ".join(rng.choice(words, rng.integers(1, 40), p=weights / weights.sum()))) for i in range(1500)] + [(10**12, None), (10**12 + 1, "w0 w0 w199")]
    found = sparse.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), "doc_id", ("text",))
    asked = [(i, list(rng.choice(words, n, p=weights / weights.sum()))) for i, n in enumerate((1, 2, 3, 5, 8))] + [(8, ["w199", "w198"]), (9, ["none"]), (10, []), (11, ["w0", "w0"])]
    queries = spark.createDataFrame([(i, [str(t) for t in ts]) for i, ts in asked], "query_id long, tokens array<string>")
    rows = lambda df: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())
    for size, k in ((16, 4), (200, 1), (5000, 30)):
        ranked, told = sparse.pruned_topk(found, sparse.bounds(found, size), queries, k)
        assert rows(ranked) == rows(sparse.topk(sparse.score(found, queries), k))
        read = {r.query_id: (r.read, r.held) for r in told.collect()}
        assert all(a <= b for a, b in read.values())
        if size == 16:
            assert sum(a for a, _ in read.values()) < 0.7 * sum(b for _, b in read.values())
    none = sparse.build(spark.createDataFrame([], "doc_id long, text string"), "doc_id", ("text",))
    assert sparse.pruned_topk(none, sparse.bounds(none), queries, 3)[0].count() == 0


def test_synonyms(spark):
    q = spark.createDataFrame([(1, ["hoca", "x", "hoca"])], "query_id long, tokens array<string>")
    assert sparse.expand(q, {"hoca": ["a", "hoca"]}).first().tokens == ["hoca", "x", "hoca", "a", "hoca", "a", "hoca"]
    assert sparse.expand(q, {}).first().tokens == ["hoca", "x", "hoca"]


def test_dense_against_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (300, 5)).astype(float)
    vectors = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)] + [(999, None)], "doc_id long, vector array<float>").repartition(5)
    queries = vectors.filter("doc_id < 40").select(F.col("doc_id").alias("query_id"), "vector")
    got: dict = {}
    for r in dense.rank_vectors(vectors, queries, 6, skip_self=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for q in range(40):
        want = sorted(((-float(v[q] @ v[i]), i) for i in range(300) if i != q))[:6]
        assert got[q] == [(i, -s) for s, i in want]
    assert dense.rank_vectors(vectors, queries.limit(0), 3).count() == 0
    assert dense.rank_vectors(vectors.limit(0), queries, 3).count() == 0


def test_regions_leave_the_best(spark):
    """Rows of the pruned dense search are those of the whole one: ties, copies, long and null vectors included."""
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(12, 8)) * 4
    v = middle[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8)) * 0.3
    v[:500] = v[0]  # a third of all rows agree
    v[500:520] = np.round(v[500:520])
    v[520] *= 50
    v[521] = 0
    rows = [(int(i) * 3 - 700, x.tolist()) for i, x in enumerate(v)] + [(10**12, None), (None, [1.0] * 8), (10**12 + 1, [float("nan")] * 8)]
    vectors = spark.createDataFrame(rows, "doc_id long, vector array<double>").repartition(5)
    found = regions.build(vectors, regions.Params(sample=900, least=30))
    assert found.facts.n.sum() == 1500 and (found.facts.n > 0).sum() > 50
    clean = vectors.filter(~F.exists("vector", lambda x: F.isnan(x)))
    queries = clean.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    told_rows = lambda df: sorted((r.query_id, r.rank, r.doc_id, round(r.score, 5)) for r in df.collect())
    for k, skip, probes in ((4, True, 2), (1, False, 1), (30, True, 1), (2000, False, 2)):
        some = queries if k < 100 else queries.filter("query_id % 13 = 0")
        ranked, told = regions.rank_vectors(found, some, k, skip, probes)
        assert told_rows(ranked) == told_rows(dense.rank_vectors(clean, some, k, skip))
        read = [(r.read, r.held) for r in told.collect()]
        assert len(read) == some.filter("vector is not null").count() and all(0 < a <= b == 1500 for a, b in read)
        if k == 4:
            assert sum(a for a, _ in read) < 0.6 * sum(b for _, b in read)
        if k == 2000:
            assert all(a == b for a, b in read)
    assert regions.rank_vectors(found, queries.limit(0), 3)[0].count() == 0
    none = regions.build(vectors.limit(0))
    assert regions.rank_vectors(none, queries, 3)[0].count() == 0


def test_encode(spark):
    df = spark.createDataFrame([("aa",), (None,)], "t string")
    got = dense.encode(df, "t", lambda texts: np.array([[3.0, 4.0]] * len(texts))).collect()
    assert [pytest.approx(r.embedding) if r.embedding else None for r in got] == [[0.6, 0.8], None]
    c = spark.createDataFrame([("T", "U", "x"), ("T U", "U", "x"), ("T", None, "x")], "title string, unit string, text string")
    assert [r[0] for r in c.select(dense.embedding_text()).collect()] == ["passage: U — T\nx", "passage: T U\nx", "passage: T\nx"]


CANDIDATES = "query_id long, doc_id long, rrf double, bm25_rank int, dense_rank int, place int, query_tokens array<string>, title_tokens array<string>, job_form boolean, source string"


def test_order(spark):
    rows = [
        (1, 10, 0.01, 1, None, 1000001, ["x"], [], False, "a"),  # first by words: to the front
        (1, 11, 0.02, 2, 1, 1, ["x"], None, False, "a"),  # first by vectors
        (1, 12, 0.03, 3, 2, 2, ["x"], ["x"], None, "a"),  # third of its source
        (1, 13, 0.02, 4, 4, 4, ["x"], ["x"], False, "b"),
        (1, 14, 0.035, 5, 5, 5, ["x"], [], True, "c"),  # a job form: penalised
        (1, 15, 0.02, 6, 6, 6, ["x"], [], False, None),
        (1, 16, 0.02, 7, 3, 3, ["x"], [], False, None),
        (2, 10, 0.01, 1, 1, 1, ["gorevi"], [], True, "a"),  # duties asked for: no penalty, once only
        (3, 10, 0.01, 1, 1, 1, [], [], True, "a"),
        (3, 11, 0.009, 2, 2, 2, [], [], False, "a"),
    ]
    got: dict = {}
    for r in hybrid.order(spark.createDataFrame(rows, CANDIDATES), SearchParams(k=6)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {1: [10, 11, 13, 16, 15, 14], 2: [10], 3: [11, 10]}


def test_gate_truth_table(spark):
    df = spark.createDataFrame([(3.0, 0.82), (2.99, 0.82), (0.0, 0.85), (12.0, 0.0), (11.99, 0.81), (None, None)], "b double, c double")
    assert [r[0] for r in df.select(hybrid.in_scope(F.col("b"), F.col("c"))).collect()] == [True, False, True, True, False, False]


def test_search_from_saved_index(spark, tmp_path):
    import datetime

    vectors = {i: [1.0, i / 10] for i, _ in DOCS}
    chunks = spark.createDataFrame([(f"{i:015x}0", f"http://x/{i % 3}", f"baslik {i}", None, "sayfa", None, t or "", False, vectors[i]) for i, t in DOCS], "chunk_id string, url string, title string, unit string, doc_type string, published_at string, text string, job_form boolean, embedding array<float>")
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    store.save(store.with_positions(chunks), path, "model", "test", datetime.datetime(2026, 1, 1))
    loaded, idx, vec = store.load(spark, path)
    assert store.meta(spark, path).first().asDict() == {"model": "model", "dim": 2, "chunks": 7, "source": "test", "built_at": "2026-01-01T00:00:00"}
    queries = spark.createDataFrame([(1, "kuş nerede", [0.0, 1.0]), (2, None, [1.0, 0.0])], "query_id long, text string, vector array<float>")
    results, gate = hybrid.search(loaded, idx, vec, queries, SearchParams(gate_cosine_alone=0.9))
    rows = {(r.query_id, r.rank): r for r in results.collect()}
    by_text = {r.pos: r.text for r in loaded.collect()}
    assert "kuş" in by_text[rows[1, 1].doc_id] and rows[1, 2].cosine == pytest.approx(0.7)
    assert all(sum(1 for (q, _), r in rows.items() if q == 1 and r.source == s) <= 2 for s in {r.source for r in rows.values()})
    assert {r.query_id: r.in_scope for r in gate.collect()} == {1: False, 2: True}
    none, shut = hybrid.search(loaded.limit(0), sparse.build(loaded.limit(0), "pos", ("text",)), vec.limit(0), queries)
    assert none.count() == 0 and [r.in_scope for r in shut.collect()] == [False, False]


def test_evaluation(spark):
    results = spark.createDataFrame([(1, 1, "T", "xx IŞIK"), (1, 5, "late", ""), (2, 1, None, None)], "query_id long, rank int, title string, text string")
    gold = spark.createDataFrame([(1, "ışık", "a"), (1, "late", "a"), (2, "q", "b"), (3, None, "b")], "query_id long, expected string, type string")
    judged = evaluation.hits(results, gold.filter("expected is null or expected <> 'late'"))
    assert sorted((r.type or "", r.n, r.hits) for r in evaluation.hit_rate(judged).collect()) == [("", 3, 1), ("a", 1, 1), ("b", 2, 0)]
