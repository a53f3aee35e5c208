"""The page store and the index in versions: merges, reruns, failures, compaction, updates."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from lexmill import storage
from lexmill.operators import sparse
from lexmill.sources import index
from lexmill.sources import store as stores

NOW = datetime.datetime(2026, 1, 1)
COLUMNS = "url string, title string, breadcrumb array<string>, unit string, doc_type string, text string, published_at string, fetched_at string, content_hash string"


def page(url, text, at):
    return (url, "T", ["A"], None, "sayfa", text, None, at, f"h{text}")


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def held(df):
    return {r.url: (r.text, r.fetched_at) for r in df.collect()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_store_follows_a_dictionary(spark, tmp_path):
    rng, want = random.Random(1), {}
    s = stores.open_store(spark, str(tmp_path / "pages"), buckets=8, most_parts=2)
    assert s.read().count() == 0
    for k in range(6):
        rows = [page(f"u{rng.randrange(30)}", rng.choice("abc"), f"t{k}") for _ in range(12)] + [page(None, "x", "t")]
        rows = list({r[0]: r for r in rows}.values())
        counts = dict.fromkeys(stores.STATUSES, 0)
        for r in rows:
            status = "rejected" if r[0] is None else "new" if r[0] not in want else "unchanged" if want[r[0]][0] == r[5] else "updated"
            counts[status] += 1
            if status in ("new", "updated"):
                want[r[0]] = (r[5], r[7])
        assert s.merge(frame(spark, rows), batch=f"b{k}") == counts
        assert held(s.read()) == want and s.version().rows == len(want)
        if k == 3:
            s.compact()
            assert held(s.read()) == want and all(len(p) <= 2 for p in s.version().parts.values())
    before = s.version()
    assert sum(s.merge(frame(spark, [page("u1", "zzz", "t")]), batch="b5").values()) == 0  # a rerun
    assert s.version() == before
    s.compact(1)
    s.vacuum(1)
    assert held(s.read()) == want and set(map(len, s.version().parts.values())) == {1}


def test_a_merge_writes_what_changes(spark, tmp_path):
    path = str(tmp_path / "pages")
    s = stores.open_store(spark, path, buckets=64)
    s.merge(frame(spark, [page(f"u{i}", f"{i} " + "some words of the page " * 50, "t0") for i in range(3000)]))
    whole = size(path)
    reader = s.version()
    s.merge(frame(spark, [page("u7", "changed", "t1"), page("v", "new", "t1"), page("u8", "8 " + "some words of the page " * 50, "t1")]))
    assert size(path) - whole < 0.1 * whole
    assert held(s.read(reader))["u7"][1] == "t0" and held(s.read())["u7"] == ("changed", "t1") and held(s.read())["u8"][1] == "t0"
    twice = s.merge(frame(spark, [page("w", "a", "1"), page("w", "b", "2")]), order="fetched_at")
    assert twice["new"] == 1 and held(s.read())["w"] == ("b", "2")
    assert stores.upsert_all(s, [frame(spark, [page("w", "c", "3")]), frame(spark, [page("w", "d", "4")])])["updated"] == 1
    assert held(s.read())["w"] == ("d", "4")


def test_failure_leaves_the_store(spark, tmp_path, monkeypatch):
    s = stores.open_store(spark, str(tmp_path / "pages"), buckets=4)
    s.merge(frame(spark, [page("a", "1", "t")]), batch="x")

    def broken(*args):
        raise OSError("no space")

    monkeypatch.setattr(stores, "commit", broken)
    with pytest.raises(OSError):
        s.merge(frame(spark, [page("a", "2", "t"), page("b", "1", "t")]), batch="y")
    monkeypatch.undo()
    assert held(s.read()) == {"a": ("1", "t")}
    assert s.merge(frame(spark, [page("a", "2", "t"), page("b", "1", "t")]), batch="y") == {"new": 1, "updated": 1, "unchanged": 0, "rejected": 0}
    with pytest.raises(FileExistsError):
        storage.commit(spark, s.path, s.version().number, "{}")


def test_stream_reruns_a_batch(spark, tmp_path):
    from lexmill.streaming import updates

    s = stores.open_store(spark, str(tmp_path / "pages"), buckets=4)
    source, marks = str(tmp_path / "in"), str(tmp_path / "marks")
    for k in range(3):
        frame(spark, [page("a", str(k), f"t{k}"), page(f"n{k}", "x", "t")]).coalesce(1).write.mode("append").parquet(source)
        updates.upsert_stream(spark.readStream.schema(COLUMNS).parquet(source), s, marks).awaitTermination()
    assert held(s.read()) == {"a": ("2", "t2"), "n0": ("x", "t"), "n1": ("x", "t"), "n2": ("x", "t")}
    again = str(tmp_path / "marks2")  # the same numbers again: all are known
    updates.upsert_stream(spark.readStream.schema(COLUMNS).parquet(source), s, again).awaitTermination()
    assert held(s.read())["a"] == ("2", "t2")


# ---------------------------------------------------------------- the index


def chunks(spark, rows):
    df = spark.createDataFrame(rows, "url string, n int, title string, text string, embedding array<float>")
    return index.with_positions(df.withColumn("chunk_id", F.substring(F.sha1(F.concat_ws("#", "url", "n")), 1, 16)).drop("n"))


def corpus(rng, urls, words="alpha beta gamma delta epsilon zeta eta theta the of and".split()):
    return [(u, n, f"title {rng.choice(words)}", " ".join(rng.choices(words, k=rng.randrange(20))), [rng.random(), 1.0]) for u in urls for n in range(rng.randrange(1, 4))]


def scores(spark, words, terms="alpha beta theta nothing title"):
    asked = spark.createDataFrame([(i, [t]) for i, t in enumerate(terms.split())] + [(9, terms.split())], "query_id long, tokens array<string>")
    return {(r.query_id, r.doc_id): r.score for r in sparse.score(words, asked).collect()}


def test_positions_keep_the_order_of_ids(spark):
    ids = ["0000000000000000", "00000000ffffffff", "7fffffffffffffff", "8000000000000000", "ffffffffffffffff"]
    assert [r.chunk_id for r in index.with_positions(spark.createDataFrame([(i,) for i in ids[::-1]], "chunk_id string")).orderBy("pos").collect()] == ids


def test_updates_equal_an_index_built_anew(spark, tmp_path):
    rng = random.Random(3)
    now = {u: corpus(rng, [u]) for u in (f"u{i}" for i in range(25))}
    flat = lambda: [r for v in now.values() for r in v]
    path = str(tmp_path / "index")
    index.save(chunks(spark, flat()), path, "m", "first", NOW)
    for k in range(2):
        changed = [f"u{rng.randrange(25)}" for _ in range(4)] + [f"new{k}"]
        now |= {u: corpus(rng, [u]) for u in changed}
        gone = f"u{k}"
        now.pop(gone, None)
        fresh = [r for u in changed if u in now for r in now[u]]
        index.update(spark, path, chunks(spark, fresh), spark.createDataFrame([(u,) for u in [*changed, gone, "unknown"]], "url string"), f"update {k}", NOW)
        held, words, vectors = index.load(spark, path)
        index.save(chunks(spark, flat()), f"{path}-{k}", "m", "anew", NOW)
        anew, rebuilt, same = index.load(spark, f"{path}-{k}")
        assert sorted(map(str, held.select(*sorted(held.columns)).collect())) == sorted(map(str, anew.select(*sorted(held.columns)).collect()))
        assert scores(spark, words) == pytest.approx(scores(spark, rebuilt), abs=2e-6)
        assert {(r.term, r.df): round(r.idf, 9) for r in words.terms.collect()} == {(r.term, r.df): round(r.idf, 9) for r in rebuilt.terms.collect()}
        assert vectors.count() == same.count()
    index.compact(spark, path, NOW)
    _, small, _ = index.load(spark, path)
    assert scores(spark, small) == pytest.approx(scores(spark, rebuilt), abs=2e-6)
    assert index.vacuum(spark, path, 1) == 3 and scores(spark, index.load(spark, path)[1]) == pytest.approx(scores(spark, rebuilt), abs=2e-6)


def test_failure_leaves_the_index(spark, tmp_path, monkeypatch):
    path, rng = str(tmp_path / "index"), random.Random(4)
    rows = corpus(rng, ["a", "b"])
    index.save(chunks(spark, rows), path, "m", "first", NOW)
    reader = index.load(spark, path)
    before = scores(spark, reader[1])

    def broken(*args):
        raise OSError("lost")

    monkeypatch.setattr(sparse, "ordered", broken)  # after the chunks, before the postings
    with pytest.raises(OSError):
        index.save(chunks(spark, corpus(rng, ["c"])), path, "m", "second", NOW)
    monkeypatch.undo()
    assert scores(spark, index.load(spark, path)[1]) == before and index.meta(spark, path).first().source == "first"
    held, _, vectors = index.load(spark, path)  # saving over the folder that is read
    both = held.join(vectors.withColumnsRenamed({"doc_id": "pos", "vector": "embedding"}), "pos")
    index.save(both.filter("url = 'a'"), path, "m", "part", NOW)
    assert {r.url for r in index.load(spark, path)[0].collect()} == {"a"}
    assert scores(spark, reader[1]) == before  # the version that a reader holds
    assert scores(spark, index.load(spark, path, 0)[1]) == before
    with pytest.raises(FileNotFoundError):
        index.load(spark, str(tmp_path / "none"))


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "index")
    index.save(chunks(spark, corpus(random.Random(5), ["a"])).limit(0), path, "m", "none", NOW)
    held, words, _ = index.load(spark, path)
    assert held.count() == 0 and scores(spark, words) == {}
