"""A polite HTTP source: spark.read.format("lexmill_http").option("urls", path of a Parquet table with a column url and,
for POST requests, a column data (string or binary; null for GET), and for requests that hang on an answer a column
follow, an array of (label, url, field)).

URLs of one host are read by one task, so that the pause between requests holds for the whole job; hosts are read in
parallel. A URL is sent as it is. With the option failures set to true, URLs without a page give a row with the last
status (null where nothing answered) and no body; else they give none.

A follow-up is a POST of one form field, whose value the option token, a pattern with one group, finds in the page. It
is sent in the same host's queue right after the page, so that pages and follow-ups share one pause. What follow-ups
answered stands in parts, in their order; one that fails has its status and no body and leaves the page as it is.
"""

from __future__ import annotations

import re
import time
import urllib.error
import urllib.request
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import urlencode, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexmill.storage import fresh_path, materialize

PARTS = "array<struct<label: string, status: int, content_type: string, body: binary>>"
SCHEMA = f"url string, final_url string, status int, content_type string, body binary, parts {PARTS}"


class Client:
    """Requests with a pause between any two, and attempts after server errors and failed connections."""

    def __init__(self, pause: float = 1.0, attempts: int = 3, timeout: float = 30.0, agent: str = "lexmill") -> None:
        self.pause, self.attempts, self.timeout, self.agent, self.last = pause, attempts, timeout, agent, 0.0

    def fetch(self, url: str, data: bytes | None = None) -> tuple | None:
        """(url, final_url, status, content_type, body), or None unless the status is 200. The wait grows with each
        attempt; client errors are final."""
        row = self.answer(url, data)
        return row if row[2] == 200 else None

    def answer(self, url: str, data: bytes | None = None) -> tuple:
        """As fetch, with the last status and a null body where there is no page. Data make a POST request."""
        status = None
        for attempt in range(1, self.attempts + 1):
            time.sleep(max(0.0, self.last + self.pause - time.monotonic()))
            self.last = time.monotonic()
            try:
                request = urllib.request.Request(url, data=data, headers={"User-Agent": self.agent})
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    if r.status == 200:
                        return url, r.geturl(), 200, r.headers.get("Content-Type", ""), r.read()
                    return url, r.geturl(), r.status, None, None
            except urllib.error.HTTPError as e:
                status = e.code
                if e.code < 500:
                    break
            except (OSError, ValueError):
                pass
            if attempt < self.attempts:
                time.sleep(self.pause * attempt)
        return url, None, status, None, None


class Host(InputPartition):
    def __init__(self, requests: list[tuple[str, bytes | None, list | None]]) -> None:
        super().__init__(None)
        self.requests = requests


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Host]:
        """One partition a host. The URLs of a crawl level, of a size that max_urls bounds, pass through here."""
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        most, hosts, n = int(self.options.get("max_urls", 1_000_000)), defaultdict(list), 0
        where = self.options["urls"]
        fs, at = FileSystem.from_uri(where if ":" in where else f"file://{where}")
        table = ds.dataset(at, format="parquet", filesystem=fs, exclude_invalid_files=True)
        wanted = ["url", *[x for x in ("data", "follow") if x in table.schema.names]]
        for batch in table.to_batches(columns=wanted):
            for row in batch.to_pylist():
                if url := row["url"]:
                    data = row.get("data")
                    hosts[urlsplit(url).netloc.lower()].append((url, data.encode() if isinstance(data, str) else data, row.get("follow")))
                    n += 1
            if n > most:
                raise ValueError(f"more than {most} URLs in a level; raise max_urls or split the level")
        return [Host(requests) for _, requests in sorted(hosts.items())] or [Host([])]

    def read(self, partition: Host) -> Iterator[tuple]:
        o = self.options
        client = Client(float(o.get("pause", 1.0)), int(o.get("attempts", 3)), float(o.get("timeout", 30.0)))
        token = re.compile(o.get("token", r"(?!)"))
        for url, data, follow in partition.requests:
            row = client.answer(url, data)
            if row[2] == 200 or o.get("failures", "false").lower() == "true":
                yield *row, follow_up(client, row[4], token, follow)


def follow_up(client: Client, body: bytes | None, token: re.Pattern, follow: list | None) -> list[tuple] | None:
    """(label, status, content type, body) of each follow-up to a page with a token; null where there are none."""
    found = token.search(body.decode("utf-8", "replace")) if body and follow else None
    if not found:
        return None
    answers = [(f["label"], client.answer(f["url"], urlencode({f["field"]: found[1]}).encode())) for f in follow]
    return [(label, *a[2:]) for label, a in answers]


def fetched(requests: DataFrame, **options: str) -> DataFrame:
    """The rows of SCHEMA for requests(url[, data][, follow]), failures included: written to the shared folder, then read once."""
    spark = requests.sparkSession
    path = fresh_path(spark, "urls")
    requests.write.parquet(path)
    spark.dataSource.register(HttpSource)
    return materialize(spark.read.format("lexmill_http").options(failures="true", **options).option("urls", path).load(), "fetched")


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexmill_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)
