"""WARC derivative builder: response records to linked metadata and plain-text conversion records.

Responses are read from gzipped WARC/1.1 files record by record (`write_warc`, `read_warc`), each a gzip member, so that
memory holds one record whatever the file's size. Deriving is a narrow projection followed by one explode, without a
shuffle. Title, text and links of a page are read in one Arrow step, in time that grows with the page, also for broken
pages. Both derivatives of a response refer to it by its identifier, target and date, name each other as concurrent,
and keep its HTTP headers and digests.

Blocks stay bytes until their headers are read: chunks and content encodings are undone, and a page is decoded by the
charset of its header, a byte order mark, its own meta element, or else as UTF-8 or Windows-1252. A payload digest that
the source record names is passed on; where it names none, one of the bytes before decoding takes its place.
"""

from __future__ import annotations

import codecs
import gzip
import hashlib
import html.entities
import io
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexmill.llm.common import append, filesystem, map_rows, replacing, short_batches, table
from lexmill.storage import fresh_path, materialize

FIELDS = ["page_id", "warc_type", "record_id", "concurrent_to", "refers_to", "refers_to_uri", "refers_to_date", "target_uri", "warc_date", "content_type", "source_headers", "source_payload_digest", "block_digest", "content_length", "block"]

# Elements that are not shown, and those that stand on lines of their own.
HIDDEN = ("script", "style", "noscript")
BREAKING = "p br div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr table article section header footer nav aside title head body html main form blockquote pre".split()

OPENERS = re.compile(rf"<(?:!--|({'|'.join(HIDDEN)})\b)", re.IGNORECASE | re.ASCII)
CLOSERS = {k: re.compile(rf"</{k}[^>]*>", re.IGNORECASE) for k in HIDDEN} | {"": re.compile("-->")}
BREAKS = re.compile(rf"</?(?:{'|'.join(BREAKING)})\b[^>]*>", re.IGNORECASE | re.ASCII)
TAGS = re.compile(r"</?[A-Za-z!][^>]*>")
TITLE = re.compile(r"<title[^>]*>", re.IGNORECASE), re.compile(r"</title[^>]*>", re.IGNORECASE)
BLANKS, BLANK_LINES = re.compile(r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]"), re.compile(r" ?\n[ \n]*")

# An anchor with its attributes, each passed over whole, so that what looks like one in a value does not count.
VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
ANCHOR = re.compile(rf"<a(?=[\s/])((?:[\s/]*+[^\s/>=]++(?:\s*+=\s*+{VALUE})?+)*+)", re.ASCII | re.IGNORECASE)
ATTRIBUTE = re.compile(rf"([^\s/>=]++)(?:\s*+=\s*+({VALUE}))?+", re.ASCII)
REFERENCES = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)([;=]?)")


def urn(x: Column) -> Column:
    """A record identifier from the SHA-256 of what it stands for: reruns agree."""
    return F.regexp_replace(F.substring(F.sha2(x, 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(x, 256))


@lru_cache(4096)
def decoded(reference: str) -> str:
    """A character reference as HTML reads it in text; no-break spaces become blanks."""
    return html.unescape(reference).replace("\xa0", " ")


def in_text(m: re.Match) -> str:
    return decoded(m[0])


def in_attribute(m: re.Match) -> str:
    """In attributes a name needs its semicolon before = and letters (?a=1&copy=2). Line ends, which URLs drop, would
    end the field."""
    if m[1][0] == "#":
        x = decoded(f"&{m[1]};").strip("\t\r\n")
        return x + m[2] if m[2] == "=" else x
    known = m[2] != "=" and m[1] + m[2] in html.entities.html5
    return decoded(m[0]).strip("\t\r\n") if known else m[0]


def unescape(text: str | None) -> str | None:
    return REFERENCES.sub(in_text, text) if text and "&" in text else text


def hrefs(payload: str) -> list[str]:
    """The href of each anchor whose first href has a value, in order, quoted or not, decoded."""
    out = []
    for attributes in ANCHOR.findall(payload):
        x = next((v for k, v in ATTRIBUTE.findall(attributes) if k.lower() == "href"), "")
        if x:
            x = x[1:-1] if x[0] in "\"'" else x
            out.append(REFERENCES.sub(in_attribute, x) if "&" in x else x)
    return out


def shown(page: str) -> str:
    """page without comments and hidden elements that are closed. A kind that is not closed any more is not looked for
    again."""
    out, at, look, open_ = [], 0, 0, dict.fromkeys(CLOSERS, True)
    while m := OPENERS.search(page, look):
        kind = (m[1] or "").lower()
        end = CLOSERS[kind].search(page, m.end()) if open_[kind] else None
        if end:
            out.append(page[at : m.start()])
            at = look = end.end()
        else:
            open_[kind], look = False, m.end()
        if not any(open_.values()):
            break
    return "".join(out) + page[at:]


def tagged(page: str) -> tuple[str, str]:
    """page up to its last >, and the rest, which holds no tag."""
    end = page.rfind(">") + 1
    return page[:end], page[end:]


def squeezed(text: str) -> str:
    return BLANK_LINES.sub("\n", BLANKS.sub(" ", text)).strip(" \n")


def without_tags(page: str) -> str:
    head, tail = tagged(page)
    return TAGS.sub("", head) + tail


def plain_text(page: str) -> str:
    """Visible text: hidden elements and comments dropped, block elements on lines of their own, all named and numeric
    references decoded."""
    head, tail = tagged(shown(page))
    return squeezed(unescape(without_tags(BREAKS.sub("\n", head) + tail)))


def title_of(page: str) -> str:
    head, _ = tagged(page)
    start = TITLE[0].search(head)
    end = TITLE[1].search(head, start.end()) if start else None
    return squeezed(unescape(without_tags(page[start.end() : end.start()]))) if end else ""


PAGE = StructType([StructField("title", StringType()), StructField("text", StringType()), StructField("links", ArrayType(StringType()))])


@F.arrow_udf(PAGE)
def read_page(x: pa.Array) -> pa.Array:
    pages = x.to_pylist()
    columns = [pa.array([f(p or "") for p in pages], t) for f, t in ((title_of, pa.string()), (plain_text, pa.string()), (hrefs, pa.list_(pa.string())))]
    return pa.StructArray.from_arrays(columns, names=PAGE.names)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record_id, target_uri, warc_date, http_headers, payload): a response record for each page. Null url
    or html count as empty. Repeated pages give repeated records with one identifier."""
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    name = F.concat_ws("|", F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), url, F.sha2(html, 256))
    return pages.select(F.col(id_col).alias("page_id"), urn(name).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), html.alias("payload"))


def derive(found: DataFrame) -> DataFrame:
    """For each response one metadata and one conversion record, with the columns of FIELDS.

    An empty payload gives an empty conversion and metadata without title and links. Links keep their order and
    repeats. Null columns of a response count as empty; an empty table gives no rows. payload_digest and payload_bytes,
    where found has them and they are not null, stand for those of the payload. Other columns are not read.
    """
    short_batches(found.sparkSession)
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    given = lambda c, own: (F.coalesce(F.col(c), own) if c in found.columns else own).alias(c)
    facts = [given("payload_digest", digest(empty("payload"))), given("payload_bytes", F.octet_length(empty("payload")).cast("long"))]
    read = found.select("page_id", *[empty(c).alias(c) for c in ("record_id", "target_uri", "warc_date", "http_headers", "payload")], *facts)
    read = read.withColumn("page", read_page("payload"))
    links = F.transform("page.links", lambda x: F.concat(F.lit("outlink: "), x, F.lit(" L a/@href")))
    fields = F.array_join(F.concat(F.array(F.concat(F.lit("title: "), F.translate("page.title", "\n", " ")), F.concat(F.lit("content-length: "), F.col("payload_bytes").cast("string"))), links), "\r\n")
    ids = [urn(F.concat_ws("|", F.lit(k), F.col("record_id"))) for k in ("metadata", "conversion")]
    wide = read.select("*", fields.alias("fields"), F.col("page.text").alias("text"), F.col("payload_digest").alias("source"), ids[0].alias("m"), ids[1].alias("c"))

    def record(kind: str, own: str, other: str, content: str, block: str) -> Column:
        b = F.col(block)
        return F.struct(F.lit(kind).alias("warc_type"), F.col(own).alias("record_id"), F.col(other).alias("concurrent_to"), F.lit(content).alias("content_type"), digest(b).alias("block_digest"), F.octet_length(b).cast("long").alias("content_length"), b.alias("block"))

    both = F.inline(F.array(record("metadata", "m", "c", "application/warc-fields", "fields"), record("conversion", "c", "m", "text/plain; charset=utf-8", "text")))
    kept = wide.select("page_id", F.col("record_id").alias("refers_to"), F.col("target_uri").alias("refers_to_uri"), F.col("warc_date").alias("refers_to_date"), "target_uri", "warc_date", F.col("http_headers").alias("source_headers"), F.col("source").alias("source_payload_digest"), both)
    return kept.select(*FIELDS)


# ---------------------------------------------------------------- files

#: Fields of a record's header and the columns that hold them.
HEADERS = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "refers_to_uri"), ("WARC-Refers-To-Date", "refers_to_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("X-Page-Id", "page_id")]
SOURCE_HEADER = "X-Source-Header"
RECORD = ", ".join(f"{c} {'long' if c == 'page_id' else 'string'}" for _, c in HEADERS) + ", source_headers string, block binary"


def as_records(found: DataFrame) -> DataFrame:
    """Responses as records that write_warc takes: the block is the HTTP response."""
    block = F.concat(F.coalesce("http_headers", F.lit("")), F.coalesce("payload", F.lit(""))).cast("binary")
    return found.select(F.lit("response").alias("warc_type"), "record_id", "target_uri", "warc_date", F.lit("application/http; msgtype=response").alias("content_type"), F.col("page_id").cast("long").alias("page_id"), block.alias("block"))


#: Labels of charsets that browsers read as others.
CHARSETS = {"iso-8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252", "iso-8859-9": "cp1254", "gb2312": "gb18030", "gbk": "gb18030", "shift_jis": "cp932", "ks_c_5601-1987": "cp949", "euc-kr": "cp949"}
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"))
META = re.compile(rb"<meta[^>]{0,300}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.IGNORECASE)
READABLE = re.compile(r"^\s*(?:$|text/|application/(?:xhtml\+xml|xml|json)\b)", re.IGNORECASE)


def unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer; what does not parse ends it, and what was read so far stays. A body that does not
    begin with a chunk is no chunked one."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return b"".join(out) if at else body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out) if at else body


def inflated(body: bytes, encoding: str) -> bytes | None:
    """body without its content encoding, as far as it goes; null for encodings that are not known here."""
    for name in reversed([x.strip().lower() for x in encoding.split(",") if x.strip()]):
        if name == "identity":
            continue
        if name in ("gzip", "x-gzip", "deflate"):
            gzipped = body[:2] == b"\x1f\x8b"
            raw = not gzipped and not (len(body) > 1 and body[0] & 15 == 8 and (body[0] << 8 | body[1]) % 31 == 0)
            d, out = zlib.decompressobj(31 if gzipped else -15 if raw else 15), []
            try:
                for i in range(0, len(body), 1 << 16):
                    out.append(d.decompress(body[i : i + (1 << 16)]))
            except zlib.error:
                if not any(out):
                    return None
            body = b"".join(out)
        elif name == "zstd":
            import zstandard

            try:
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            except zstandard.ZstdError:
                return None
        else:
            return None
    return body


def decode_page(body: bytes, content_type: str) -> str:
    """The text of a page by the first charset that is named and known: byte order mark, header, meta element; else
    UTF-8 if it is that, else Windows-1252. Bytes that the charset lacks become U+FFFD."""
    for mark, name in MARKS:
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    told = re.search(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", content_type, re.IGNORECASE)
    meta = META.search(body[:4096])
    for name in (told and told[1], meta and meta[1].decode("ascii")):
        if name:
            try:
                codec = codecs.lookup(CHARSETS.get(name.lower(), name))
                # A page that names UTF-16 in ASCII letters is none, and some codecs give no text.
                return body.decode("utf-8" if codec.name.startswith("utf-16") and name is not (told and told[1]) else codec.name, "replace")
            except (LookupError, ValueError):
                continue
    try:
        return body.decode()
    except UnicodeDecodeError:
        return body.decode("cp1252", "replace")


def open_response(block: bytes | None) -> tuple[str, str, str, int]:
    """(HTTP headers, text, digest, bytes) of a response's block: the digest and size are those of the body without
    chunks, before content encodings are undone. Bodies of other kinds than text, and of encodings that are not known,
    have no text."""
    block = block or b""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        head, body = b"", block
    try:
        headers = (head + found).decode()
    except UnicodeDecodeError:
        headers = (head + found).decode("latin-1")
    fields: dict[str, str] = {}
    for line in headers.split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = unchunked(body)
    kind, told = fields.get("content-type", ""), f"sha256:{hashlib.sha256(body).hexdigest()}"
    whole = inflated(body, fields.get("content-encoding", "")) if READABLE.match(kind) else None
    return headers, decode_page(whole, kind) if whole is not None else "", told, len(body)


def as_responses(records: DataFrame) -> DataFrame:
    """The responses among records: (page_id, record_id, target_uri, warc_date, http_headers, payload, payload_digest,
    payload_bytes); payload is text (see open_response), the digest that of the record, or else of its body. The headers
    end with the first empty line; a block without one is all payload. Revisits have no payload of their own and, like
    other kinds of records, give no row."""
    found = records.filter("warc_type = 'response'")
    told = F.col("payload_digest") if "payload_digest" in records.columns else F.lit(None).cast("string")
    found = found.select("page_id", "record_id", "target_uri", "warc_date", told.alias("told"), F.col("block").cast("binary").alias("block"))
    keep = ["page_id", "record_id", "target_uri", "warc_date", "told"]
    opened = append(found, "block", lambda: lambda blocks: list(map(open_response, blocks)), "http_headers string, payload string, own string, payload_bytes long", keep)
    return opened.select(*keep[:-1], "http_headers", "payload", F.coalesce("told", "own").alias("payload_digest"), "payload_bytes")


def write_warc(records: DataFrame, directory: str | None = None, file_bytes: int = 1 << 30) -> DataFrame:
    """(path, records): gzipped files of each partition that has rows, a new one when the last reached file_bytes.

    Columns of HEADERS, source_headers and block that records lacks, and null or empty ones, are left out of a record's
    header; a null block is empty. Line ends in header values are written as %0D and %0A, and blanks at their ends are
    lost when read. An empty table gives no files. Files appear whole, under names that a retried task writes anew."""
    directory = directory or fresh_path(records.sparkSession, "warc")
    wanted = [c for _, c in HEADERS] + ["source_headers", "block"]
    kind = lambda c: "binary" if c == "block" else "string"
    source = records.select(*[F.col(c).cast(kind(c)).alias(c) if c in records.columns else F.lit(None).cast(kind(c)).alias(c) for c in wanted])

    def make():
        part = TaskContext.get().partitionId()

        def member(row) -> bytes:
            text = lambda v: v.replace(b"\r", b"%0D").replace(b"\n", b"%0A")
            lines = [b"WARC/1.1", *(name.encode() + b": " + text(v) for (name, _), v in zip(HEADERS, row, strict=False) if v)]
            lines += [SOURCE_HEADER.encode() + b": " + text(x) for x in (row[-2] or b"").split(b"\r\n") if x]
            block = row[-1] or b""
            lines.append(b"Content-Length: %d" % len(block))
            return gzip.compress(b"\r\n".join([*lines, b"", b""]) + block + b"\r\n\r\n", compresslevel=1, mtime=0)

        def run(rows):
            row, number = next(rows, None), 0
            while row is not None:
                path, n, size = f"{directory}/part-{part:06d}-{number:04d}.warc.gz", 0, 0
                with replacing(path) as out:
                    while row is not None and size < file_bytes:
                        data = member(row)
                        out.write(data)
                        n, size, row = n + 1, size + len(data), next(rows, None)
                yield path, n
                number += 1

        return run

    return materialize(map_rows(source, make, "path string, records long"), "warc_files")


class Inflated(io.RawIOBase):
    """The bytes of a gzip file's members. A file that ends or breaks within one gives what was read up to there, and
    then ends."""

    def __init__(self, raw) -> None:
        self.raw, self.held, self.member, self.ended = raw, b"", None, False

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.ended:
            last = not self.held and not (more := self.raw.read(1 << 16))
            self.held = self.held or (b"" if last else more)
            if self.member is None:
                self.held = self.held.lstrip(b"\0")  # padding between members
                if not self.held:
                    self.ended = last
                    continue
                self.member = zlib.decompressobj(31)
            try:
                out = self.member.decompress(self.held, len(buffer))
            except zlib.error:
                self.ended = True
                break
            self.held = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if self.member.eof:
                self.member = None
            self.ended = last and not out
            if out:
                buffer[: len(out)] = out
                return len(out)
        return 0


def parse_warc(file) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers, block) of each record of an uncompressed WARC stream, one at a time; header names in lower case,
    repeats in lists. A stream that ends within a record gives what there is of its block."""
    while line := file.readline():
        if not line.strip():
            continue
        headers: dict[str, list[str]] = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        length = headers.get("content-length", ["0"])[0]
        yield headers, file.read(int(length) if length.isdigit() else 0)


def read_warc(spark, path: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """Every record of the .warc and .warc.gz files of a folder, or of files(path), in the columns of RECORD. Tasks take
    whole files and hold one record at a time. Fields that a record lacks are null, a page id that is no number too;
    blocks are bytes as they stand. A folder without files gives no rows."""
    if files is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path")  # contents are not read
    key = HEADERS[-1][0].lower()

    def run(rows):
        for (name,) in rows:
            fs, at = filesystem(name.decode())
            with fs.open_input_stream(at, compression=None) as raw, io.BufferedReader(Inflated(raw) if at.endswith(".gz") else raw, 1 << 20) as file:
                for headers, block in parse_warc(file):
                    values = [headers.get(k.lower(), [None])[0] for k, _ in HEADERS]
                    number = headers.get(key, [""])[0]
                    values[-1] = int(number) if re.fullmatch("-?[0-9]{1,18}", number) else None
                    told = headers.get(SOURCE_HEADER.lower())
                    yield *values, "\r\n".join(told) + "\r\n\r\n" if told else None, block

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return map_rows(files.select("path").repartition(width), lambda: run, RECORD)


def op3_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    files = write_warc(as_records(responses(table(spark, sf_dir, "pages"))))
    return derive(as_responses(read_warc(spark, files=files)))


# ---------------------------------------------------------------- the same records in SQL


def _sql() -> str:
    """Written for RE2 and lists: the table of references is that of the standard library."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    crlf = "chr(13) || chr(10)"
    names = {k: v.replace("\xa0", " ") for k, v in html.entities.html5.items()}
    entities = f"ent as materialized (select map([{', '.join(map(q, names))}], [{', '.join(map(q, names.values()))}]) m)"
    number = "case when lower(r[2:2]) = 'x' then ('0x' || rtrim(r[3:], ';'))::bigint else rtrim(r[2:], ';')::bigint end"
    # r: the reference at the start of a piece behind an ampersand, p: the piece.
    text_piece = f"""case when r = '' then '&' || p
      when r[1] = '#' then replace(chr(({number})::int), chr(160), ' ') || p[len(r) + 1:]
      else coalesce((select first(m[r[1:k]] || p[k + 1:] order by k desc) from (select unnest(range(2, len(r) + 1)) k) where m[r[1:k]] is not null), '&' || p) end"""
    link_piece = f"""case when r = '' then '&' || p
      when r[1] = '#' then chr(({number})::int) || p[len(r) + 1:]
      when p[len(r) + 1:len(r) + 1] <> '=' and m[r] is not null then m[r] || p[len(r) + 1:] else '&' || p end"""

    def decoded(source: str, keys: str, name: str, piece: str) -> str:
        """CTE name(keys, x): column x of source with its references decoded."""
        return f"""{name} as materialized (select {keys}, coalesce(string_agg(case when i = 1 then p else {piece} end, '' order by i), '') x
  from (select *, regexp_extract(p, '^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)', 1) r from (select {keys}, unnest(string_split(x, '&')) p, generate_subscripts(string_split(x, '&'), 1) i from {source})), ent group by {keys})"""

    drop = lambda x, pattern, to="''": f"regexp_replace({x}, {q(pattern)}, {to}, 'g')"
    squeeze = lambda x: f"trim({drop(drop(x, '[ \t\r\f\v]{2,}|[\t\r\f\v]', q(' ')), ' ?\n[ \n]*', 'chr(10)')}, ' ' || chr(10))"
    hidden = "(?is)<!--.*?-->|" + "|".join(rf"<{k}\b.*?</{k}[^>]*>" for k in HIDDEN)
    text = drop(drop(drop("h", hidden), rf"(?i)</?(?:{'|'.join(BREAKING)})\b[^>]*>", "chr(10)"), "</?[A-Za-z!][^>]*>")
    title = drop("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title[^>]*>', 1)", "</?[A-Za-z!][^>]*>")
    value = r"""(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
    tags = rf"(?i)<a[\s/](?:[\s/]*[^\s/>=]+(?:\s*=\s*{value})?)*"
    attribute = rf"([^\s/>=]+)(?:\s*=\s*({value}))?"
    make_urn = lambda x: "'<urn:uuid:' || " + " || '-' || ".join(f"substr(sha256({x}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"
    return f"""
with {entities},
p as (select page_id, coalesce(url, '') u, coalesce(html, '') h from pages),
r as materialized (select *, {make_urn("'response|' || coalesce(page_id::varchar, '') || '|' || u || '|' || sha256(h)")} rid,
  'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(h) || {crlf} || {crlf} headers from p),
u as (select distinct rid, h from r),
{decoded(f"(select rid, {text} x from u)", "rid", "texts", text_piece)},
{decoded(f"(select rid, {title} x from u)", "rid", "titles", text_piece)},
a as (select rid, unnest(t) t, generate_subscripts(t, 1) n from (select rid, regexp_extract_all(h, {q(tags)}) t from u)),
v as (select rid, n, list_filter(list_zip(regexp_extract_all(t[3:], {q(attribute)}, 1), regexp_extract_all(t[3:], {q(attribute)}, 2)), lambda y: lower(y[1]) = 'href')[1][2] x from a),
{decoded("(select rid, n, case when x[1] in (chr(34), chr(39)) then x[2:-2] else x end x from v where x <> '')", "rid, n", "hrefs", link_piece)},
links as (select rid, string_agg({crlf} || 'outlink: ' || x || ' L a/@href', '' order by n) x from hrefs group by 1),
d as (select r.*, {make_urn("'metadata|' || rid")} m, {make_urn("'conversion|' || rid")} c, {squeeze("texts.x")} tx,
  'title: ' || replace({squeeze("titles.x")}, chr(10), ' ') || {crlf} || 'content-length: ' || strlen(h) || coalesce(links.x, '') fl
  from r join texts using (rid) join titles using (rid) left join links using (rid)),
k as (select *, 'metadata' kind, m own, c other, 'application/warc-fields' ct, fl b from d union all select *, 'conversion', c, m, 'text/plain; charset=utf-8', tx from d)
select page_id, kind warc_type, own record_id, other concurrent_to, rid refers_to, u refers_to_uri, '2024-01-01T00:00:00Z' refers_to_date, u target_uri, '2024-01-01T00:00:00Z' warc_date,
  ct content_type, headers source_headers, 'sha256:' || sha256(h) source_payload_digest, 'sha256:' || sha256(b) block_digest, strlen(b)::bigint content_length, b block from k
"""


OP3_SQL = _sql()
