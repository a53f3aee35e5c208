"""Decontamination, mixing and the pipeline."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, mixing, toxicity


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("most", [50_000, 5])
def test_decontamination(spark, docs, most):
    long = " ".join(f"w{i}" for i in range(500, 530))
    items = [(1, long), (2, "the cat the"), (3, None), (4, ""), (5, "nothing of this kind is anywhere at all in these texts"), (6, "ONE"), (6, "one"), (7, "word " * 12), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.benchmark_hits(docs, bench, keep=("doc_id", "text"), params=decontaminate.Params(max_windows=most)).collect()
    assert len(got) == docs.count()
    for r in got:
        w, hit, found = words_of(r.text), set(), set()
        for item, text in items:
            x = words_of(text)
            n = min(10, len(x))
            for i in range(len(x) - n + 1) if item is not None and n else ():
                at = [j for j in range(len(w) - n + 1) if w[j : j + n] == x[i : i + n]]
                hit |= {k for j in at for k in range(j, j + n)}
                found |= {str(item)} if at else set()
        assert (r.hit_words, r.hit_items) == (len(w), sorted(found))
        assert {k for a, b in zip(r.hit_starts, r.hit_ends, strict=True) for k in range(a, b)} == hit
    assert decontaminate.benchmark_hits(docs.limit(0), bench).count() == 0
    assert all(r.hit_items == [] for r in decontaminate.benchmark_hits(docs, bench.limit(0)).collect())


def targets(sizes):
    """Targets of sources {name: size}, by filling again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        want = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if want[s] > 3 * sizes[s]}
        if not over:
            return want | {s: 3.0 * sizes[s] for s in full}
        full |= over


@pytest.mark.parametrize("bucket", [4096, 3])
def test_mixing(spark, docs, bucket):
    rows = [(1000 + i, " ".join(["w"] * (i * 7 % 23)), ["big", "big", "big", "mid", "tiny"][i % 5]) for i in range(200)]
    df = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("size", F.lit("clash"))
    got = mixing.mix(df, params=mixing.Params(bucket_rows=bucket)).collect()
    again = mixing.mix(df.repartition(7), params=mixing.Params(bucket_rows=bucket)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == df.count()
    sizes: dict = {}
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = targets(sizes)
    source = {r.doc_id: r.source for r in df.collect()}
    taken: dict = {}
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert mixing.mix(df.limit(0)).count() == 0
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    at, before = docs, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        before, at = at, corpus_pipeline.materialize(out, name)
        if name == "near_dedup":
            from .test_near_dedup import brute

            groups = brute(sorted((r.doc_id, r.text) for r in before.collect()))
            assert {r.doc_id for r in at.collect()} == {i for i, (c, _) in groups.items() if i == c}
        if name == "decontamination":
            items = [words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            windows = {" ".join(x[i : i + 10]) for x in items for i in range(max(1, len(x) - 9)) if x}
            clean = lambda t: not any(f" {w} " in " " + " ".join(words_of(t)) + " " for w in windows)
            assert {r.doc_id for r in at.collect()} == {r.doc_id for r in before.collect() if clean(r.text)}
        if name == "mixing":
            assert {r.doc_id for r in at.collect()} <= {r.doc_id for r in before.collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert at.count() == before.count()
    for r in at.collect():
        assert r.n_tokens == len(tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids) + 1


SCHEMA = "doc_id long, text string, source string"


def test_stage_near_dedup_by_rows(spark):
    import corpus_pipeline

    a, b, c, d = ([f"{x}{i}" for i in range(60)] for x in "abcd")
    near = lambda w: " ".join([*w[:30], "changed", *w[31:]])
    a, b, c, d, near_a, near_d = *map(" ".join, (a, b, c, d)), near(a), near(d)
    rows = [(None, a), (None, a), (None, near_a), (7, b), (7, b), (7, c), (7, near_d), (3, d), (None, None), (None, ""), (9, ""), (9, ""), (None, "one"), (4, "one"), (None, "two")]
    docs = spark.createDataFrame([(*r, f"s{i}") for i, r in enumerate(rows)], SCHEMA).repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text if r.text != near_a else a) for r in kept.collect())
    assert got == Counter([(None, a), (7, b), (7, c), (3, d), (None, None), (None, ""), (9, ""), (9, ""), (4, "one"), (None, "two")])
    assert sorted(map(str, kept.collect())) == sorted(map(str, corpus_pipeline.drop_near_duplicates(spark, docs.repartition(5), "").collect()))


def test_stage_mixing_by_rows(spark):
    import corpus_pipeline

    rows = [(None if i % 3 == 0 else 5 if i % 7 == 0 else i, " ".join([f"w{i}"] * (i * 5 % 90)), ["big", "big", "mid", None][i % 4]) for i in range(240)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sizes: Counter = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want: Counter = Counter()
    for s, target in targets(sizes).items():
        name = lambda r: f"{'' if r[0] is None else r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}"
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(f"mix:{name(r)}".encode()).hexdigest()[:15], name(r), len(r[1].split())))
        epochs, rest = divmod(int(target + 0.5), sizes[s])
        for r in own:
            n = len(r[1].split())
            want[r] += epochs + (rest > 0) if n else 1
            rest -= n
    got = corpus_pipeline.mix_sources(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(tuple(r) for r in got.collect()) == +want


def test_stage_toxicity_by_rows(spark, tmp_path):
    import corpus_pipeline

    rows, labels = [], []
    for i in range(300):
        toxic = int(i % 3 == 0)
        rows.append((i, " ".join([f"word{(i * k) % 83}" for k in range(1, 25)] + [f"bad{i % 4}"] * toxic), "s"))
        labels.append((i, toxic))
    rows += [(None, f"word{i} word2 {'bad1' if i % 2 else 'word3'}", "s") for i in range(20)] + [(1, f"word{i} word9 {'bad2' if i % 2 else 'word4'}", "t") for i in range(6)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    model.prepare()
    want = Counter(r for r in rows if model.score((r[1] or "").encode()) < 0.5)
    assert Counter(tuple(r) for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()) == want
    assert 0 < sum(n for r, n in want.items() if r[0] is None) < 21
