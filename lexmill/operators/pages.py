"""Page records: kind, construction, validation, keyed upsert, stratified sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.text import any_substring, filled_lines, strip
from lexmill.schema import ANNOUNCEMENT, DATED_TYPES, DOC_TYPES, NEWS, PAGE, PAGE_FIELDS, PDF, STAFF, TABLE, PageParams
from lexmill.storage import materialize

# Parts of a URL that tell the kind of a page; the first kind that matches wins.
URL_TYPES = (
    (ANNOUNCEMENT, ("/duyurudetay/", "duyurudetay")),
    (NEWS, ("/haberdetay/", "haberdetay")),
    (STAFF, ("akademikpersonel", "idaripersonel", "telefonrehberi", "personeldetay", "prsnl=")),
    (TABLE, ("bolumderslistesigetir", "bolumdersleri", "ogretimplani", "dersplani", "sinavprogram")),
)


def classify_response(df: DataFrame, url: str = "url", content_type: str = "content_type", body: str = "body", by_path: bool = True) -> DataFrame:
    """df with kind (pdf, html or null) and html (the body as UTF-8 where it is HTML). A PDF is told by its content
    type or, with by_path, by the path of its URL or of the column final_url, where redirects led, if there is one."""
    low = F.lower(F.coalesce(F.col(content_type), F.lit("")))
    pdf = low.contains("pdf")
    for c in (url, *[x for x in ("final_url",) if x in df.columns]) if by_path else ():
        pdf = pdf | F.coalesce(F.lower(F.col(c)).rlike(r"^[^?#]*\.pdf(?:[?#]|$)"), F.lit(False))
    return df.withColumn("kind", F.when(pdf, "pdf").when(low.contains("html"), "html")).withColumn("html", F.when(F.col("kind") == "html", F.decode(F.col(body), "UTF-8")))


def doc_type(url: Column, text: Column, pdf: Column | bool = False, p: PageParams = PageParams()) -> Column:
    """The kind of a page: by its URL, else a table if most of more than table_lines lines hold a bar, else a page."""
    low, pdf = F.lower(F.coalesce(url, F.lit(""))), pdf if isinstance(pdf, Column) else F.lit(pdf)
    lines = filled_lines(F.coalesce(text, F.lit("")))
    bars = F.size(F.filter(lines, lambda s: s.contains("|")))
    out = F.when(pdf, PDF)
    for kind, parts in URL_TYPES:
        out = out.when(any_substring(low, parts), kind)
    return out.when((F.size(lines) > p.table_lines) & (bars > p.table_share * F.size(lines)), TABLE).otherwise(PAGE)


def title_and_unit(df: DataFrame, unit_marker: str) -> DataFrame:
    """df(url, heading, menu, unit, breadcrumb, ...) with title, unit and breadcrumb set: below a URL with unit_marker
    the heading names the unit; with a menu name and a unit, the title is both."""
    named = F.col("url").contains(unit_marker) & (F.coalesce(F.col("heading"), F.lit("")) != "")
    out = df.withColumn("unit", F.coalesce(F.nullif(F.col("unit"), F.lit("")), F.when(named, F.col("heading"))))
    both = (F.coalesce(F.col("menu"), F.lit("")) != "") & F.col("unit").isNotNull()
    out = out.withColumn("title", F.when(both, F.concat_ws(" — ", "unit", "menu")).otherwise(F.col("heading")))
    empty = F.size(F.coalesce(F.col("breadcrumb"), F.array().cast("array<string>"))) == 0
    first = F.when(F.col("unit").isNotNull(), F.array(F.lit("Akademik"), F.col("unit"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("breadcrumb", F.when(empty, first).otherwise(F.col("breadcrumb")))


def child_breadcrumb(breadcrumb: Column, menu: Column, p: PageParams = PageParams()) -> Column:
    """What the links of a page inherit: its breadcrumb and menu name, the last few."""
    grown = F.concat(breadcrumb, F.array(menu))
    tail = F.slice(grown, F.greatest(F.size(grown) - p.breadcrumb_tail + 1, F.lit(1)), p.breadcrumb_tail)
    return F.when(F.coalesce(menu, F.lit("")) != "", tail).otherwise(breadcrumb)


def records(df: DataFrame, fetched_at: Column | str, p: PageParams = PageParams()) -> DataFrame:
    """Page records of df(url, title, breadcrumb, unit, doc_type, text, published_at). Rows with too short a text go;
    an unknown kind and a dated kind without a date become plain pages; only dated kinds keep a date; an empty title
    becomes the unit or the last part of the URL; empty members of the breadcrumb go."""
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    kind = F.when(F.col("doc_type").isin(*DOC_TYPES), F.col("doc_type")).otherwise(PAGE)
    kind = F.when(kind.isin(*DATED_TYPES) & F.col("published_at").isNull(), PAGE).otherwise(kind)
    last = F.regexp_extract(F.regexp_replace("url", "/+$", ""), "[^/]*$", 0)
    title = F.coalesce(F.nullif(strip(F.coalesce(F.col("title"), F.lit(""))), F.lit("")), F.nullif(F.col("unit"), F.lit("")), last)
    crumbs = F.filter(F.coalesce(F.col("breadcrumb"), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    out = df.select("url", title.alias("title"), crumbs.alias("breadcrumb"), F.nullif(F.col("unit"), F.lit("")).alias("unit"), kind.alias("doc_type"), text.alias("text"), "published_at")
    out = out.withColumn("published_at", F.when(F.col("doc_type").isin(*DATED_TYPES), F.col("published_at")))
    stamp = F.lit(fetched_at) if isinstance(fetched_at, str) else fetched_at
    return out.filter(F.length("text") >= p.min_chars).withColumn("fetched_at", stamp).withColumn("content_hash", F.sha1(F.encode("text", "UTF-8")))


def upsert(old: DataFrame, new: DataFrame, key: str = "url", version: str | None = None) -> DataFrame:
    """Every row of the merged store with status: new, updated, unchanged or kept. An unchanged row is the old one, its
    fetch time included. Of rows of new with one key the last wins: the greatest by the column version, or any where
    none is named. Rows of new without a key take no part. old must hold a key once."""
    columns = old.columns
    fresh = new.filter(F.col(key).isNotNull())
    by = F.desc(version) if version else F.desc("content_hash")
    fresh = fresh.withColumn("__nth", F.row_number().over(W.partitionBy(key).orderBy(by))).filter("__nth = 1")
    a = old.select(F.col(key).alias("__key"), F.struct(*columns).alias("__old"))
    b = fresh.select(F.col(key).alias("__key"), F.struct(*columns).alias("__new"))
    status = F.when(F.col("__new").isNull(), "kept").when(F.col("__old").isNull(), "new").when(F.col("__old.content_hash") == F.col("__new.content_hash"), "unchanged").otherwise("updated")
    joined = a.join(b, "__key", "full_outer").withColumn("status", status)
    row = F.when(F.col("status").isin("kept", "unchanged"), F.col("__old")).otherwise(F.col("__new"))
    return joined.select(row.alias("__row"), "status").select("__row.*", "status")


#: Rules of a page record in the order of their messages: the message and the condition under which it is raised.
def page_errors(p: PageParams = PageParams()) -> list[tuple[str, Column]]:
    c = F.col
    dated = c("doc_type").isin(*DATED_TYPES)
    return [
        ("url", ~F.coalesce(c("url").startswith("http"), F.lit(False))),
        ("url encoded again", F.coalesce(c("url").contains("%2B") | c("url").contains("%3D"), F.lit(False))),
        ("url with space", F.coalesce(c("url").contains(" "), F.lit(False))),
        ("title empty", F.coalesce(strip(c("title")), F.lit("")) == ""),
        ("breadcrumb not a list", c("breadcrumb").isNull()),
        ("doc_type unknown", ~F.coalesce(c("doc_type").isin(*DOC_TYPES), F.lit(False))),
        ("text too short", F.coalesce(F.length(strip(c("text"))), F.lit(0)) < p.min_chars),
        ("published_at not a date", c("published_at").isNotNull() & ~(c("published_at").rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.try_to_date("published_at", "yyyy-MM-dd").isNotNull())),
        ("published_at missing", F.coalesce(dated, F.lit(False)) & c("published_at").isNull()),
        ("fetched_at not a time", ~F.coalesce(c("fetched_at").contains("T"), F.lit(False))),
        ("content_hash not sha1", ~F.coalesce(c("content_hash").rlike(r"^[0-9a-f]{40}\z"), F.lit(False))),
    ]


def validate(pages: DataFrame, p: PageParams = PageParams()) -> DataFrame:
    """pages with errors, an array of messages that is empty for a valid row."""
    found = F.array(*[F.when(bad, F.lit(message)) for message, bad in page_errors(p)])
    return pages.withColumn("errors", F.filter(found, lambda e: e.isNotNull()))


def validate_lines(lines: DataFrame, p: PageParams = PageParams()) -> DataFrame:
    """(line, url, doc_type, unit, errors) of lines(line, value) of JSON. A line that is no JSON object has one error;
    missing fields end the checks of a line; blank lines go. A url that stood on an earlier line is reported with it."""
    given = lines.filter(strip(F.col("value")) != "")
    keys = F.json_object_keys("value")
    parsed = given.withColumn("__keys", keys).withColumn("__row", F.from_json("value", "url string, title string, breadcrumb string, unit string, doc_type string, text string, published_at string, fetched_at string, content_hash string"))
    wide = parsed.select("line", "value", "__keys", "__row.*")
    kind = lambda name, ok: F.try_variant_get(F.try_parse_json("value"), f"$.{name}", "string").isNotNull() & ~F.coalesce(F.schema_of_variant(F.variant_get(F.try_parse_json("value"), f"$.{name}", "variant")).rlike(ok), F.lit(False))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, PAGE_FIELDS)), "__keys"))
    extra = F.array_sort(F.array_except("__keys", F.array(*map(F.lit, PAGE_FIELDS))))
    named = lambda label, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{label}: "), F.array_join(a, ", ")))
    checks = page_errors(p)
    unit = ("unit not a string", kind("unit", "^STRING|^VOID"))
    checks[5:5] = [unit]
    checks = [(m, ~F.coalesce(F.col("breadcrumb").startswith("["), F.lit(False)) if m == "breadcrumb not a list" else bad) for m, bad in checks]
    rest = F.when(F.size(missing) == 0, F.array(*[F.when(bad, F.lit(m)) for m, bad in checks])).otherwise(F.array().cast("array<string>"))
    first = F.min("line").over(W.partitionBy("url"))
    again = F.when(F.col("url").isNotNull() & (F.size(missing) == 0) & (first < F.col("line")), F.concat(F.lit("url repeated from line "), first.cast("string")))
    found = F.when(F.col("__keys").isNull(), F.array(F.lit("not a JSON object"))).otherwise(F.concat(F.array(named("missing", missing), named("not in the schema", extra)), rest, F.array(again)))
    return wide.select("line", "url", "doc_type", "unit", F.filter(found, lambda e: e.isNotNull()).alias("errors"))


def error_report(checked: DataFrame, cap: int = 30) -> DataFrame:
    """The first cap rows with errors, in line order: a report, not a filter."""
    return checked.filter(F.size("errors") > 0).orderBy("line").limit(cap)


def counts(checked: DataFrame) -> DataFrame:
    """One row: total, valid and invalid rows."""
    return checked.agg(F.count("*").alias("total"), F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.size("errors") > 0).alias("invalid"))


def type_counts(checked: DataFrame, order: str = "line") -> DataFrame:
    """Valid rows of each kind, the most frequent first, ties by first appearance."""
    valid = checked.filter(F.size("errors") == 0)
    return valid.groupBy("doc_type").agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first")


def unit_counts(checked: DataFrame, top: int = 8, missing: str = "(general)", order: str = "line") -> DataFrame:
    """The top units of valid rows; rows without a unit count under the name missing."""
    valid = checked.filter(F.size("errors") == 0)
    unit = F.coalesce(F.nullif(F.col("unit"), F.lit("")), F.lit(missing))
    return valid.groupBy(unit.alias("unit")).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(top)


def missing_types(checked: DataFrame, required: tuple[str, ...] = (STAFF, TABLE, PDF, ANNOUNCEMENT)) -> DataFrame:
    """Required kinds of which no valid row exists."""
    wanted = checked.sparkSession.createDataFrame([(t,) for t in required], "doc_type string")
    return wanted.join(checked.filter(F.size("errors") == 0).select("doc_type").distinct(), "doc_type", "left_anti")


def stratified_sample(df: DataFrame, most: int, stratum: str, order: str, length: Column, floor: int = 2) -> DataFrame:
    """About `most` rows of df, spread over strata and, within each, evenly over lengths: every stratum gives `floor`
    rows, the rest goes in proportion; positions and quotas are rounded half to even. All rows if there are no more
    than `most`. A null stratum is one of its own.

    Ranks within a stratum come from a range sort and counts of its partitions, so that a stratum with most of the
    rows is no single task."""
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    base = F.least(F.lit(floor), F.col("n"))
    sizes = df.groupBy(F.col(stratum).alias("__s")).agg(F.count("*").alias("n"))
    left = F.greatest(F.lit(most) - F.sum(base).over(W.partitionBy(F.lit(1))), F.lit(0))
    spare = F.greatest(F.sum(F.col("n") - base).over(W.partitionBy(F.lit(1))), F.lit(1))
    quota = F.least(F.col("n"), base + F.bround(left * (F.col("n") - base) / spare).cast("long"))
    quotas = sizes.select("__s", "n", F.when(total <= most, F.col("n")).otherwise(quota).alias("quota"))
    ranked = _ranked(df.withColumn("__s", F.col(stratum)), length, order)
    joined = ranked.join(quotas.withColumnRenamed("__s", "__t"), F.col("__s").eqNullSafe(F.col("__t")))
    # Row r is taken if some i < quota has bround(i * (n - 1) / (quota - 1)) = r.
    step = (F.col("n") - 1) / F.greatest(F.col("quota") - 1, F.lit(1))
    near = F.bround(F.col("__r") / step)
    hit = F.exists(F.array(near - 1, near, near + 1), lambda i: (i >= 0) & (i < F.col("quota")) & (F.bround(i * step) == F.col("__r")))
    taken = F.when(F.col("quota") >= F.col("n"), True).when(F.col("quota") == 1, F.col("__r") == 0).otherwise(hit & (F.col("quota") > 0))
    return joined.filter(taken).select(*df.columns)


def _ranked(df: DataFrame, length: Column, order: str) -> DataFrame:
    """df with __r, the rank from 0 within __s by length and order."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Written once: the bounds of a range sort need not be the same when it is computed again.
    placed = materialize(df.withColumn("__len", length).repartitionByRange(parts, "__s", "__len", order).withColumn("__p", F.spark_partition_id()), "ranges")
    w = W.partitionBy("__p", "__s").orderBy("__len", order)
    local = placed.withColumn("__i", F.row_number().over(w) - 1)
    before = W.partitionBy("__s").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("__p", "__s").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    offsets = offsets.select(F.col("__p").alias("__op"), F.col("__s").alias("__os"), "__before")
    joined = local.join(offsets, (F.col("__p") == F.col("__op")) & F.col("__s").eqNullSafe(F.col("__os")))
    return joined.withColumn("__r", F.col("__i") + F.col("__before")).drop("__op", "__os", "__before", "__i", "__n")
