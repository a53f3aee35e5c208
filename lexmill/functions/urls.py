"""URL scope, identity and kind as expressions. URLs are never re-encoded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


@dataclass(frozen=True)
class Scope:
    """Which URLs belong to a crawl. Names in parameters are matched as whole parameter names."""

    hosts: tuple[str, ...]
    denied_hosts: tuple[str, ...] = ()
    # Files without text, and paths that never end.
    extensions: tuple[str, ...] = tuple(".jpg .jpeg .png .gif .webp .svg .ico .bmp .zip .rar .7z .exe .mp3 .mp4 .avi .wmv .doc .docx .ppt .pptx .xls .xlsx".split())
    fragments: tuple[str, ...] = ("/en/", "takvimgetir", "galeri", "fotogaleri", "videogaleri", "?print", "print=1", "logout", "cikis")
    parameters: tuple[str, ...] = ("ay", "yil")


def in_scope(url: Column, s: Scope) -> Column:
    """False for null."""
    low = F.lower(F.concat(path(url), F.lit("?"), query(url)))
    ok = scheme(url).isin("http", "https") & host(url).isin(*s.hosts)
    if s.denied_hosts:
        ok = ok & ~host(url).isin(*s.denied_hosts)
    for x in s.extensions:
        ok = ok & ~F.lower(path(url)).endswith(x)
    for x in s.fragments:
        ok = ok & ~low.contains(x)
    if s.parameters:
        ok = ok & ~low.rlike(rf"[?&](?:{'|'.join(s.parameters)})=")
    return F.coalesce(ok, F.lit(False))


def identity(url: Column) -> Column:
    """The key under which URLs are the same page: scheme and host in lower case, no slash at the end of the path, no
    fragment, the query as it is."""
    trimmed = F.regexp_replace(path(url), "/+$", "")
    tail = F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise("")
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(trimmed == "", "/").otherwise(trimmed), tail)


def is_pdf(url: Column) -> Column:
    return F.coalesce(F.lower(path(url)).endswith(".pdf"), F.lit(False))


def is_person(url: Column, marker: str) -> Column:
    return F.coalesce(F.lower(url).contains(marker.lower()), F.lit(False))
