"""A crawl from seeds to page records: round by round, a join with what was seen, a fetch, and one pass over its answers."""

from __future__ import annotations

import datetime
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lexmill.functions.urls import Scope, identity, is_person
from lexmill.operators import html, ingest
from lexmill.operators.crawl import LINK, LIST, CrawlParams, admissible, next_level, numbered
from lexmill.schema import PageParams
from lexmill.sources.store import PageStore
from lexmill.storage import materialize

CONTEXT = "menu string, unit string, breadcrumb array<string>, depth int"
# The tabs of a person's page that are asked for, by the last part of their address, and their labels.
TABS = (("KisiselBilgiler", "Akademik Görevler ve Öğrenim Bilgisi"), ("DersListesi", "Verdiği Dersler"))


@dataclass(frozen=True)
class PersonTabs:
    """Where the tabs of a person's page are asked for: by POST to endpoint/tab, the page's token in one field."""

    endpoint: str
    tabs: tuple[tuple[str, str], ...] = TABS
    field: str = "id"


@dataclass(frozen=True)
class Crawl:
    records: DataFrame  # page records, as pages.records gives them
    visits: DataFrame  # seq, key, url, depth, from_key, status: a row for each page asked for, numbered in queue order
    counters: dict[str, int]  # requests, answered, failed, records: observed while the crawl wrote its tables


def counts(visits: DataFrame) -> DataFrame:
    """(status, n) of the visits: how many pages came, failed by status, or were not answered (null)."""
    return visits.groupBy("status").agg(F.count("*").alias("n"))


def requests(level: DataFrame, tabs: PersonTabs | None, c: CrawlParams) -> DataFrame:
    """(url[, follow]) of a level: with tabs, person pages carry the requests that hang on their token."""
    if not tabs:
        return level.select("url")
    follow = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(f"{tabs.endpoint.rstrip('/')}/{tab}").alias("url"), F.lit(tabs.field).alias("field")) for tab, label in tabs.tabs])
    return level.select("url", F.when(is_person(F.col("url"), c.person_marker), follow).alias("follow"))


def crawl(
    seeds: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    scope: Scope,
    today: datetime.date,
    fetched_at: Column | str,
    extractor: Callable[[bytes], list[str]] | None = None,
    tabs: PersonTabs | None = None,
    courses_endpoint: str | None = None,
    c: CrawlParams = CrawlParams(),
    h: html.HtmlParams = html.HtmlParams(),
    p: PageParams = PageParams(),
) -> Crawl:
    """Records and visits of a crawl from seeds(url[, menu, unit, breadcrumb, place]), in the order of one queue.

    fetch turns requests(url[, follow]) into (url, final_url, status, content_type, body[, parts]), as
    sources.http.fetched does. Pages stand in a queue, seeds by place, then by key; what a page offers goes to its end:
    embedded files at the page's own depth, then links one deeper. A page is met once, by the first offer of it, and
    takes unit and breadcrumb from there. Course lists are asked for with the page that first names them and stand in no
    queue. max_pages pages of the queue are asked for, failed ones included. Each round takes all that stands in the
    queue, numbered (crawl.numbered); only numbers of pages come to the driver.

    PDFs are read if there is an extractor, persons' tabs and course lists are asked for where their endpoints are
    named. Failed pages have a visit and no record; a person's page without a token or whose tabs fail keeps its own
    text.
    """
    spark = seeds.sparkSession
    given = [x for x in ("menu", "unit", "breadcrumb") if x in seeds.columns]
    empty = {"menu": F.lit(None).cast("string"), "unit": F.lit(None).cast("string"), "breadcrumb": F.array().cast("array<string>")}
    place = F.col("place").cast("long") if "place" in seeds.columns else F.lit(0).cast("long")
    first = seeds.select("url", *[F.col(x) if x in given else v.alias(x) for x, v in empty.items()], F.lit(0).alias("depth"), F.lit(0).cast("long").alias("from_seq"), F.lit(LINK).alias("kind"), place.alias("place"), F.lit(None).cast("string").alias("from_key"))
    counters: Counter = Counter(requests=0, answered=0, failed=0, records=0)

    def recorded(df: DataFrame) -> DataFrame:
        told = Observation()
        out = materialize(df.observe(told, F.count("*").alias("records")), "records")
        counters.update(told.get)
        return out

    seen = spark.createDataFrame([], "key string")
    offered, begun, records, visits = first, 0, [], []
    while True:
        queued = admissible(offered.filter(F.col("kind") != LIST), "url", scope, c).unionByName(offered.filter(F.col("kind") == LIST))
        fresh = materialize(next_level(queued.withColumn("key", identity(F.col("url"))), seen), "offers")
        seen = seen.unionByName(fresh.select("key"))
        if courses_endpoint and visits:
            lists = fresh.filter(F.col("kind") == LIST).select("url", "unit", "breadcrumb")
            got = fetch(lists.select("url")).filter("status = 200").select("url", "content_type", "body").join(lists, "url")
            records.append(recorded(ingest.course_records(got, fetched_at, p, h)))
        level = numbered(fresh.filter(F.col("kind") != LIST), begun).filter(F.col("seq") < c.max_pages)
        n = level.count()
        if not n:
            break
        begun += n
        answers = fetch(requests(level, tabs, c))
        columns = [x for x in ("final_url", "status", "content_type", "body", "parts") if x in answers.columns]
        told = Observation()
        ok = F.coalesce(F.col("status") == 200, F.lit(False))
        asked = level.join(answers.select("url", *columns), "url", "left").observe(told, F.count("*").alias("requests"), F.count_if(ok).alias("answered"), F.count_if(~ok).alias("failed"))
        got = materialize(asked, "answers")
        counters.update(told.get)
        visits.append(got.select("seq", "key", "url", "depth", "from_key", "status"))
        pages = got.filter("status = 200").drop("key", "from_key", "from_seq", "kind", "place", "status")
        rows = materialize(ingest.parsed(pages.drop("seq"), h, c), "parsed")
        records.append(recorded(ingest.html_records(rows, today, fetched_at, p)))
        if extractor:
            records.append(recorded(ingest.pdf_records(pages, extractor, fetched_at, p)))
        offered = ingest.offers(rows, c)
        if courses_endpoint:
            offered = offered.unionByName(ingest.course_lists(rows, courses_endpoint))
        offered = offered.join(pages.select(F.col("url").alias("from_url"), F.col("seq").alias("from_seq")), "from_url").withColumn("from_key", identity(F.col("from_url"))).withColumn("place", F.col("place").cast("long")).drop("from_url")
    if not visits:
        none = spark.createDataFrame([], f"url string, content_type string, body binary, {CONTEXT}")
        return Crawl(ingest.html_records(ingest.parsed(none, h, c), today, fetched_at, p), spark.createDataFrame([], "seq long, key string, url string, depth int, from_key string, status int"), dict(counters))
    return Crawl(reduce(DataFrame.unionByName, records), reduce(DataFrame.unionByName, visits), dict(counters))


def crawl_into(store: PageStore, done: Crawl, batch: str | None = None) -> dict[str, int]:
    """Merges a crawl's records into a store, which counts new, updated, unchanged and rejected ones; a page's record is
    that of the newest fetch."""
    return store.merge(done.records, batch, "fetched_at")
