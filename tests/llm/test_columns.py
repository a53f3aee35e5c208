"""Every stage and every keep on a table whose columns bear the names that operators use, and a map."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import decontaminate, licenses, media, mixing, near_dedup, pieces, pii, token_counts, toxicity

SF = "/root/testdata/sf0.001"
NAMES = "score predicted held_out __text __id __th __doc hit_items hit_words row copies base extra rep n c n_words n_tokens media error labels ids begins k0 a0 t text_2 __both key size taken tie label".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with every name, a map, a name with a dot, and values that tell the row they belong to."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = docs.orderBy("doc_id").limit(60)
    odd = spark.createDataFrame([(None, "no id here at all", "en", "s0", 17), (9001, None, None, None, 0), (9002, "", "en", "s0", 0)], few.schema)
    df = few.unionByName(odd).unionByName(few.limit(5))
    more = {x: F.concat(F.lit(f"{x}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for x in NAMES}
    return df.withColumns({**more, "a.b": F.col("doc_id") * 2, "pairs": F.create_map(F.lit("id"), F.col("doc_id"))}).repartition(3)


def values(df, columns):
    """Rows as text, in order."""
    return sorted(str([r[c] for c in columns]) for r in df.select(*[f"`{c}`" for c in columns]).collect())


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_leave_columns_as_they_are(spark, clashing, name, stage):
    out = stage(spark, clashing, SF)
    assert out.columns == clashing.columns and out.dtypes == clashing.dtypes
    rows = out.collect()
    assert rows
    for r in rows:
        told = "none" if r.doc_id is None else str(r.doc_id)
        assert all(r[x] == f"{x}:{told}" for x in NAMES) and r["pairs"] == {"id": r.doc_id} and r["a.b"] == (None if r.doc_id is None else 2 * r.doc_id)
    assert set(values(out, clashing.columns)) <= set(values(clashing, clashing.columns))


def test_last_stage(spark, clashing):
    assert corpus_pipeline.write_shards(spark, clashing, SF).count() == clashing.count()


@pytest.mark.parametrize("name", ["toxicity", "decontaminate", "pii", "tokens", "licenses", "media", "pieces"])
def test_kept_columns_come_out_unchanged(spark, clashing, name):
    keep = ("doc_id", *NAMES, "pairs", "a.b")
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    run = {
        "toxicity": lambda: toxicity.score_toxicity(clashing, read("labels"), keep=keep),
        "decontaminate": lambda: decontaminate.benchmark_hits(clashing, read("benchmark"), keep=keep),
        "pii": lambda: pii.find_personal_data(clashing, keep=keep),
        "tokens": lambda: token_counts.token_counts(clashing, keep=keep[1:]),
        "licenses": lambda: licenses.scan_licenses(clashing, keep=keep),
        "media": lambda: media.encode_media(clashing, keep=keep),
        "pieces": lambda: pieces.encode(clashing, keep=keep),
    }
    out = run[name]()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    names = out.columns[: len(keep)]
    assert all(n.endswith(k) for n, k in zip(names, keep, strict=True))
    assert values(out.select(*[F.col(f"`{n}`").alias(k) for n, k in zip(names, keep, strict=True)]), keep) == values(clashing, keep)


def test_mix_and_near_duplicates(spark, clashing):
    rows = mixing.mix(clashing, keep=tuple(clashing.columns)).select("row.*")
    assert values(rows, clashing.columns) == values(clashing, clashing.columns)
    assert near_dedup.near_duplicates(clashing).count() == clashing.count()


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("x0", "one two three four five"), ("x1", "one two three four five"), ("7", "six seven")], "doc_id string, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(-1, -1, False), (-1, -1, False), (7, 7, True)]
    assert sorted(r.doc_id for r in near_dedup.first_documents(docs).collect()) in (["7", "x0"], ["7", "x1"])
