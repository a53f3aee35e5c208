"""From fetched responses to page records and to the links that a crawl offers next: one pass over a level."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.dates import published_at
from lexmill.functions.urls import is_person
from lexmill.operators import html, pages
from lexmill.operators.crawl import FILE, LINK, LIST, CrawlParams
from lexmill.schema import DATED_TYPES, TABLE, PageParams
from lexmill.sources import pdf

CONTEXT = ("menu", "unit", "breadcrumb", "depth")
NO_CRUMBS = "array<string>"
# Fixed value: the name of course lists.
COURSES = "Ders Listesi (AKTS)"


def parsed(fetched: DataFrame, h: html.HtmlParams = html.HtmlParams(), c: CrawlParams = CrawlParams()) -> DataFrame:
    """HTML rows of fetched(url, content_type, body, menu, unit, breadcrumb, depth[, final_url][, parts]) with heading,
    text, title, unit, breadcrumb, links, pdfs and html. A person's page takes its name from the page; its text is its
    own, then that of the parts that answered with a page, under their labels. A page without parts keeps its own."""
    rows = html.extract(pages.classify_response(fetched).filter("kind = 'html'"), p=h)
    person = is_person(F.col("url"), c.person_marker)
    out = rows.select("url", "html", *CONTEXT, F.when(person, F.col("page.person")).otherwise(F.col("page.title")).alias("heading"), F.col("page.text").alias("text"), "page.links", "page.pdfs", "page.tables")
    if "parts" in fetched.columns:
        told = html.person_text(tab_texts(fetched.filter(person), h)).withColumnRenamed("text", "__told")
        out = out.join(told, "url", "left").withColumn("text", F.concat_ws("\n\n", F.nullif("text", F.lit("")), "__told")).drop("__told")
    return pages.title_and_unit(out, c.unit_marker)


def tab_texts(fetched: DataFrame, h: html.HtmlParams = html.HtmlParams()) -> DataFrame:
    """(url, tab_no, label, body) of the parts of fetched(url, parts) that answered with HTML: their texts."""
    each = fetched.select(F.col("url").alias("page_url"), F.posexplode("parts").alias("tab_no", "part")).filter("part.status = 200")
    answers = each.select("page_url", "tab_no", "part.label", F.col("page_url").alias("url"), "part.content_type", "part.body")
    texts = html.extract(pages.classify_response(answers, by_path=False).filter("kind = 'html'"), p=h)
    return texts.select(F.col("page_url").alias("url"), "tab_no", "label", F.col("page.text").alias("body"))


def html_records(rows: DataFrame, today: datetime.date, fetched_at: Column | str, p: PageParams = PageParams()) -> DataFrame:
    """Page records of parsed rows. Dates without a year count on announcements and news only."""
    typed = rows.withColumn("doc_type", pages.doc_type(F.col("url"), F.col("text"), p=p))
    dated = typed.withColumn("published_at", published_at(F.col("text"), today, F.col("doc_type").isin(*DATED_TYPES), p))
    return pages.records(dated, fetched_at, p)


def pdf_records(fetched: DataFrame, extractor: Callable[[bytes], list[str]], fetched_at: Column | str, p: PageParams = PageParams()) -> DataFrame:
    """Page records of the PDF rows; those without text go."""
    rows = pdf.pdf_records(pdf.text(pages.classify_response(fetched).filter("kind = 'pdf'"), extractor))
    return pages.records(rows.withColumn("published_at", F.lit(None).cast("string")), fetched_at, p)


def course_lists(rows: DataFrame, endpoint: str) -> DataFrame:
    """(url, menu, unit, breadcrumb, depth, from_url, kind, place) of the course lists of the programmes that parsed
    rows name: offers that are asked for at once, after a page's files and before its links."""
    found = rows.select(F.posexplode(html.program_ids(F.col("html"))).alias("place", "id"), "unit", children_crumbs().alias("breadcrumb"), "depth", F.col("url").alias("from_url"))
    return found.select(F.concat(F.lit(f"{endpoint}?id="), "id").alias("url"), F.lit(COURSES).alias("menu"), "unit", "breadcrumb", "depth", "from_url", F.lit(LIST).alias("kind"), "place")


def course_records(fetched: DataFrame, fetched_at: Column | str, p: PageParams = PageParams(), h: html.HtmlParams = html.HtmlParams()) -> DataFrame:
    """Page records of fetched course lists(url, content_type, body, unit, breadcrumb): their tables alone, under the
    unit of the page that named them."""
    rows = html.extract(pages.classify_response(fetched, by_path=False).filter("kind = 'html'"), p=h)
    title = F.concat_ws(" — ", F.coalesce("unit", F.lit("Bölüm")), F.lit(COURSES))
    out = rows.select("url", title.alias("title"), "breadcrumb", "unit", F.lit(TABLE).alias("doc_type"), F.col("page.tables").alias("text"), F.lit(None).cast("string").alias("published_at"))
    return pages.records(out, fetched_at, p)


def children_crumbs() -> Column:
    return pages.child_breadcrumb(F.coalesce("breadcrumb", F.array().cast(NO_CRUMBS)), F.col("menu"))


def offers(rows: DataFrame, c: CrawlParams = CrawlParams()) -> DataFrame:
    """(url, menu, unit, breadcrumb, depth, from_url, kind, place) that parsed rows offer: embedded PDFs at their own
    depth, links one deeper unless the depth is reached."""
    base = rows.withColumns({"from_url": F.col("url"), "breadcrumb": children_crumbs()})
    columns = ["url", "menu", "unit", "breadcrumb", "depth", "from_url", "kind", "place"]
    files = base.select("*", F.posexplode("pdfs").alias("place", "to")).withColumns({"url": F.col("to"), "menu": F.coalesce(F.nullif("menu", F.lit("")), F.col("heading")), "kind": F.lit(FILE)})
    deeper = base.filter(F.col("depth") < c.depth).select("*", F.posexplode("links").alias("place", "to"))
    deeper = deeper.withColumns({"url": F.col("to.url"), "menu": F.nullif(F.col("to.text"), F.lit("")), "depth": F.col("depth") + 1, "kind": F.lit(LINK)})
    return files.select(*columns).unionByName(deeper.select(*columns))
