"""Mixing sources to target weights, in DataFrame operations alone.

Every document gets a hash-random key; keys are dealt to the ranges of their source, so many that each holds about
bucket_rows documents: a range sort whose bounds are known, since keys are uniform, and that moves no rows. Bucket sums and their prefix sums tell in which bucket a source's budget ends; documents in
buckets before it are taken, those after are not, and only the bucket of the cut is sorted and summed document by
document. Whole epochs come first where a budget exceeds its source. No window spans more than one bucket's
documents, or one row a bucket or source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import column, count_words, fingerprint, table
from lexmill.storage import materialize


@dataclass(frozen=True)
class Params:
    weights: tuple[float, ...] = (1, 2, 3)  # of the sources in order, repeating
    most: int = 3  # targets stop at this many times their source's size
    seed: str = "mix"
    bucket_rows: int = 4096


KEY_BITS = 60


def source_targets(sizes: DataFrame, p: Params) -> DataFrame:
    """(source, n, source_size, target): shares of the total by weight, stopped at `most` times the source's size, the
    excess shared out again by weight. With sources in the order in which they fill, the common level is the first
    that the next source does not fall short of. A row a source."""
    totals = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in p.weights]), (rank % len(p.weights) + 1).cast("int")))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    room = F.sum("source_size").over(everything) - p.most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = room / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = weighed.withColumn("level", level).withColumn("place", F.row_number().over(fill))
    ends = F.when(p.most * F.col("source_size") / F.col("weight") >= F.col("level"), F.struct("place", "level"))
    levels = levels.withColumn("level", F.min(ends).over(everything)["level"])
    target = F.least((p.most * F.col("source_size")).cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.lit(0.0)))
    return levels.select("source", "n", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", params: Params = Params(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row, and with keep a struct `row` of these columns; taken
    counts the words of each epoch, and the document at a source's cut gives just the words that the budget, the rounded
    target, still lacks.

    Null and empty texts have size 0 and are taken for nothing. A null source is a source of its own, last in order.
    The key of a row is a hash of its id and text, so that rows without an id or with a repeated one are spread like any
    others; only rows that agree in both share a key. Reruns agree, whatever the partitions; with keep, ties go by a hash
    of its columns, of any type. Other columns are not read. An empty table gives
    no rows.
    """
    p = params
    name = F.concat_ws(":", F.lit(p.seed), F.coalesce(column(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(column(text_col).cast("string"), F.lit(""))))
    spread = F.md5(name.cast("binary"))
    key = F.conv(F.substring(spread, 1, KEY_BITS // 4), 16, 10).cast("long")
    kept = [F.struct(*map(column, keep)).alias("row"), fingerprint(docs, keep).alias("tie")] if keep else []
    source = docs.select(column(id_col).alias("doc_id"), column(source_col).alias("source"), count_words(text_col).alias("size"), key.alias("key"), *kept)
    sizes = materialize(source, "sizes")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    plan = source_targets(sizes, p).withColumn("budget", budget).withColumn("buckets", F.ceil(F.col("n") / p.bucket_rows).cast("long"))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).cast("long"))
    plan = materialize(plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")), "targets")

    def placed(plan: DataFrame) -> DataFrame:
        """Each document beside its source's row of the plan, with its bucket."""
        joined = sizes.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        bucket = F.least(F.floor(F.col("key") / float(1 << KEY_BITS) * F.col("buckets")).cast("long"), F.col("buckets") - 1)
        return joined.select("d.*", *[F.col(f"p.{c}") for c in plan.columns if c != "source"], bucket.alias("bucket"))

    sums = placed(plan.select("source", "buckets", "rest")).groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = sums.withColumn("before", before).filter("before <= rest and rest < before + words").select("source", F.col("bucket").alias("cut"), "before")
    cuts = plan.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.*", F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("before", F.lit(0)).alias("before"))
    rows = placed(materialize(cuts, "cuts"))
    epochs = F.col("epochs") * F.col("size")
    clear = rows.filter("bucket <> cut").withColumn("taken", epochs + F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(0))
    until = Window.partitionBy("source").orderBy("key", "doc_id", "size", *(["tie"] if keep else [])).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(until), F.lit(0))
    edge = rows.filter("bucket = cut").withColumn("taken", epochs + F.greatest(F.lit(0), F.least(F.col("size"), left)))
    columns = ["doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), *(["row"] if keep else [])]
    return clear.select(*columns).unionByName(edge.select(*columns))


def op8_mix_to_weights(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.withColumn("target", F.round("target", 6))


OP8_SQL = r"""
with d as materialized (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size, ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint as hashed from documents),
s as (select source, sum(size)::double source_size, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double w from d group by 1),
o as (select *, sum(source_size) over () total, sum(w) over () ws,
  coalesce(sum(source_size) over (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) bs,
  coalesce(sum(w) over (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) bw,
  row_number() over (order by source_size / w, source nulls last) place from s),
l as (select *, (total - 3 * bs) / (ws - bw) lev from o),
f as (select arg_min(lev, place) lev from l where 3 * source_size / w >= lev),
t as (select source, source_size, least(3 * source_size, coalesce(w * (select lev from f), 0)) target from l),
r as (
  select d.*, t.source_size, t.target, floor(t.target + 0.5) budget,
    coalesce(sum(size) over (partition by d.source order by hashed, doc_id, size rows between unbounded preceding and 1 preceding), 0) before
  from d join t on d.source is not distinct from t.source)
select doc_id, size::bigint size, source_size::bigint source_size, round(target, 6) target,
  (case when source_size > 0 then floor(budget / source_size) * size + greatest(0, least(size, budget - floor(budget / source_size) * source_size - before)) else 0 end)::bigint taken
from r
"""
