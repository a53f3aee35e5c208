import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import near_dedup as nd


def brute(rows, p=nd.Params()):
    """(component, n) of each (id, text) by comparing all sets."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(p.shingle, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and label[a] != label[b] and p.similarity[1] * len(sets[a] & sets[b]) >= p.similarity[0] * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (c, len(s)) for (i, _), c, s in zip(rows, label, sets, strict=True)}


def variants(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("cell", [512, 7])
def test_against_brute_force(spark, cell):
    rng = random.Random(5)
    texts = [None, "", "  ", "a", "a", "A b", "a b c"]
    for size, most in ((60, 14), (25, 5), (3, 2)):
        texts += variants(rng, [f"b{size}w{i}" for i in range(120)], size, most)
    texts += [texts[10]] * 5
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("n_shingles", F.lit("clash"))
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in nd.near_duplicates(df, params=nd.Params(cell=cell, cell_shingles=cell * 200)).collect()}
    assert got == brute(sorted(rows))


def test_edges(spark, docs):
    got = nd.near_duplicates(docs)
    assert got.count() == docs.count()
    by = {r.doc_id: r for r in got.dropDuplicates(["doc_id"]).collect()}
    assert [by[i].n_shingles for i in (0, 1, 2, 3)] == [0, 0, 0, 1] and all(by[i].kept for i in (0, 1, 2, 3))
    assert by[5].component_id == 4 and not by[5].kept
    assert by[None].component_id is None and not by[None].kept
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_ids_with_unlike_texts(spark):
    rng = random.Random(7)
    rows = []
    for k in range(12):
        texts = [variants(rng, [f"b{k}x{j}w{i}" for i in range(120)], 4, 3) for j in range(2)]
        rows += [(10 * k, texts[0][0]), (10 * k, texts[1][0])] + [(10 * k + 1 + j, t) for j, t in enumerate(texts[0][1:] + texts[1][1:])]
    rng.shuffle(rows)
    got = {(r.doc_id, r.component_id) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {(i, i - i % 10) for i, _ in rows}


def test_sketches():
    p = nd.Params()
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 400, dtype=np.uint64) for _ in range(2))
    assert (nd.merge(nd.sketch(a, p), nd.sketch(b, p)) == nd.sketch(np.union1d(a, b), p)).all()
    pairs, truth = [], []
    for share in np.linspace(0.3, 0.99, 40):
        n = int(400 * 2 * share / (1 + share))
        c = np.concatenate((a[:n], b[n:]))
        pairs.append(nd.sketch(c, p))
        truth.append(n / (800 - n))
    ok = nd.possible(np.repeat(nd.sketch(a, p)[None], 40, axis=0), np.array(pairs), np.full(40, 400.0), np.full(40, 400.0), p)
    assert ok[np.array(truth) >= 0.8].all() and not ok[np.array(truth) < 0.4].any()


def test_connected(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    got = dict(tuple(r) for r in nd.connected(spark.createDataFrame(chain, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_documents_around_one_template(spark):
    """Unlike documents that share most of their words, in one bucket each: links and none of the others, quickly."""
    import time

    rng = random.Random(5)
    template = [f"t{i}" for i in range(300)]
    rows, n = [], 1500
    for i in range(n):
        own = [f"o{i}_{k}" for k in range(58 if i % 10 else 12)]
        at = rng.randrange(1, 290)
        rows.append((i, " ".join(template[:at] + own + template[at:] if i % 3 else own + template)))
    rows += [(n + i, rows[i][1] + " and an end") for i in range(0, 200, 7)]
    sets = {i: nd.shingle_set(t.encode(), 4) for i, t in rows}
    began = time.time()
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), params=nd.Params(cell=100)).collect()}
    took = time.time() - began
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    # Overlaps as a product of matrices over the shingles that several documents hold.
    vocabulary, place, often = np.unique(np.concatenate(list(sets.values())), return_inverse=True, return_counts=True)
    column = np.cumsum(often > 1) - 1
    from_row, shared = np.repeat(np.arange(len(sets)), [len(s) for s in sets.values()]), often[place] > 1
    dense = np.zeros((len(sets), int((often > 1).sum())), dtype=np.float32)
    dense[from_row[shared], column[place[shared]]] = 1
    common, size, ids = dense @ dense.T, np.array([len(s) for s in sets.values()]), list(sets)
    for x, y in zip(*np.nonzero(100 * common >= 80 * (size[:, None] + size[None] - common)), strict=True):
        a, b = root(ids[x]), root(ids[y])
        parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in sets}
    assert took < 120
