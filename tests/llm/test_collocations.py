"""Collocations against counts in dictionaries, the perfect hash against sets."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import collocations as co

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=10, top=2000, share=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longest = Counter()
    for (lang, w), a in kept.items():
        if len(w) == 3:
            for part in (w[:2], w[1:]):
                longest[lang, part] = max(longest[lang, part], a)
    out = {}
    for (lang, w), a in kept.items():
        if len(w) == 2 and 100 * longest[lang, w] >= share * a and longest[lang, w]:
            continue
        score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


def made_up(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "York", "city", "hall", "über", "日本", "x" * 40, "a-b", "é", *[f"w{i}" for i in range(60)]]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randrange(60))
        rows.append((rng.choice(["en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " new york "]) for w in words)))
    return rows + [("en", None), ("en", ""), (None, " .. ,, "), ("fr", "ab " * 5000), ("fr", "once"), *rows[:4]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").withColumn("word", F.lit(1)).withColumn("key", F.create_map(F.lit("a"), F.lit(1))).repartition(5)


def same(df, want):
    assert sorted(tuple(r[c] for c in COLUMNS) for r in df.collect()) == want


def test_against_brute_force(spark):
    rows = made_up(1, 300)
    same(co.collocations(frame(spark, rows)), brute(rows))


def test_several_blocks_and_segments_give_the_same(spark):
    rows = made_up(2, 200)
    same(co.collocations(frame(spark, rows), params=co.Params(block=20, segment=7, fan=2, blob=16, top=25)), brute(rows, top=25))


def test_one_long_text_without_breaks(spark):
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choice(["a", "b", "c", "d", "e"]) for _ in range(400_000)))]
    same(co.collocations(frame(spark, rows), params=co.Params(blob=100)), brute(rows))


@pytest.mark.parametrize("rows", [[("en", "only a few words")], [(None, None)], [("en", "a. a. a. a. a. a. a. a. a. a. a.")], [("en", "a b. " * 12)]])
def test_little_input(spark, rows):
    same(co.collocations(frame(spark, rows)), brute(rows))
    assert co.collocations(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 63, 1000, 200_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(1, 1 << 63, n + 10, dtype=np.uint64))[:n]
    h = co.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(n))
    others = rng.integers(1, 1 << 63, 5000, dtype=np.uint64)
    assert (h.slots(others[~np.isin(others, keys)]) == -1).all()
    if n > 1000:
        assert sum(b.nbytes + r.nbytes for _, b, r in h.levels) < 1.3 * n  # bytes besides the stored keys


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = con.execute(co.OP12_SQL)
    assert [d[0] for d in want.description] == COLUMNS
    got = co.op12_collocations(spark, sf)
    assert got.columns == COLUMNS
    same(got, sorted(want.fetchall()))
