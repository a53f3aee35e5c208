"""Chunks of page records, in expressions over arrays of lines: no Python, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import filled_lines, first_match, lines_of, lower_tr, squeeze, strip, word_count, words_of
from lexmill.schema import ANNOUNCEMENT, NEWS, PDF, STAFF, TABLE, ChunkParams

# Headings of terms, navigation lines, boiler-plate lines, texts without content, marks of job forms.
TERM_HEADING = r"(?iU)^\s*(DÖNEM\s+\d+|GÜZ\s+YARIYILI|BAHAR\s+YARIYILI|\d+\.\s*YARIYIL)\s*\z"
NAVIGATION = ("anasayfa", ">", "duyuru detay", "haber detay", "detay")
BOILERPLATE = (
    r"(?iU)©\s*copyright|tüm hakları saklıdır|bilgi için\s*:|kalitekoordinatorlugu@|sayfa\s+\d+\s*/\s*\d+|"
    r"doküman\s*no|i̇?lk yayın tarihi|revizyon\s*(?:no|tarihi)"
)
PLACEHOLDERS = ("program seçiniz", "seçiniz", "tıklayınız")
JOB_MARKERS = ("görev unvanı", "bağlı alt unvanlar", "vekalet eden", "üst birim adı", "görevin tanımı")


def caseless(c: Column) -> Column:
    """Lower case for comparisons, dotless and dotted i told apart by Turkish rules."""
    return lower_tr(c, compatibility=False)


def repair_spacing(text: Column, p: ChunkParams = ChunkParams()) -> Column:
    """Lines whose letters were set apart by spaces are closed up; runs of spaces there were gaps between words."""

    def one(line: Column) -> Column:
        tokens = words_of(line)
        single = F.size(F.filter(tokens, lambda t: F.length(t) == 1))
        closed = F.replace(F.replace(F.regexp_replace(line, " {2,}", "\x00"), F.lit(" "), F.lit("")), F.lit("\x00"), F.lit(" "))
        return F.when((F.size(tokens) >= p.spaced_tokens) & (single >= p.spaced_share * F.size(tokens)), closed).otherwise(line)

    return F.array_join(F.transform(lines_of(text), one), "\n")


def is_job_form(text: Column, p: ChunkParams = ChunkParams()) -> Column:
    low = caseless(text)
    return sum((low.contains(m).cast("int") for m in JOB_MARKERS), F.lit(0)) >= p.job_markers


def boilerplate(line: Column) -> Column:
    return line.rlike(BOILERPLATE)


def strides(words: Column, p: ChunkParams = ChunkParams()) -> Column:
    """Pieces of a word array: `window` words every window - overlap words; the last may lie within the one before."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(p.window - p.overlap))
    return F.when(F.size(words) > 0, F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, p.window), " "))).otherwise(F.array().cast("array<string>"))


def windows(text: Column, p: ChunkParams = ChunkParams()) -> Column:
    """Texts of sliding windows: lines are packed while they fit; a full window is emitted and its last words start
    the next one. A line longer than a window is cut into strides first.

    Only the lines' numbers of words are folded, into the lines where windows begin; texts are cut once, from the lines
    and from the row of all their words, of which a window's first words are those before its first line."""
    pieces = F.flatten(F.transform(filled_lines(text), lambda s: F.when(word_count(s) > p.window, strides(words_of(s), p)).otherwise(F.array(s))))
    kind = "array<struct<a:int,b:int,t:long,f:long>>"
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("a"), zero.alias("w"), zero.alias("n"), zero.alias("t"), zero.alias("f"), F.array().cast(kind).alias("done"))

    def window(acc: Column) -> Column:
        return F.concat(acc["done"], F.array(F.struct(acc["a"].alias("a"), acc["i"].alias("b"), acc["t"].alias("t"), acc["f"].alias("f"))))

    def step(acc: Column, size: Column) -> Column:
        full = (acc["i"] > acc["a"]) & (acc["n"] + size > p.window)
        tail = F.least(acc["n"], F.lit(p.overlap).cast("long"))
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(full, acc["i"]).otherwise(acc["a"]).alias("a"),
            (acc["w"] + size).alias("w"),
            F.when(full, tail + size).otherwise(acc["n"] + size).alias("n"),
            F.when(full, tail).otherwise(acc["t"]).alias("t"),
            F.when(full, acc["w"]).otherwise(acc["f"]).alias("f"),
            F.when(full, window(acc)).otherwise(acc["done"]).alias("done"),
        )

    def cut(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda s: word_count(s).cast("long"))
        cuts = F.aggregate(sizes, start, step, lambda acc: F.when(acc["i"] > 0, window(acc)).otherwise(acc["done"]))

        def texts(words: Column) -> Column:
            before = lambda c: F.when(c["t"] > 0, F.array_join(F.slice(words, (c["f"] - c["t"] + 1).cast("int"), c["t"].cast("int")), " "))
            return F.transform(cuts, lambda c: F.concat_ws("\n", before(c), F.array_join(F.slice(pieces, c["a"] + 1, c["b"] - c["a"]), "\n")))

        return once(F.flatten(F.transform(pieces, words_of)), texts)

    return once(pieces, cut)


def _prefixed(texts: Column, prefix: Column) -> Column:
    return F.transform(texts, lambda t: F.concat(prefix, t))


def staff_chunks(text: Column, title: Column, p: ChunkParams = ChunkParams()) -> Column:
    return F.when(word_count(text) <= p.window, F.array(text)).otherwise(_prefixed(windows(text, p), F.concat(title, F.lit("\n"))))


def term_blocks(text: Column) -> Column:
    """array<struct<heading, lines>>: lines between term headings. A heading without lines is dropped, its name goes
    with it; lines before the first heading have a null heading. Headings are found first, then lines are sliced."""

    def blocks(lines: Column) -> Column:
        marks = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("at"), first_match(x, TERM_HEADING, 1).alias("heading"))), lambda m: m["heading"].isNotNull())
        none = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("heading"))

        def cut(marks: Column) -> Column:
            until = F.concat(F.slice(F.transform(marks, lambda m: m["at"]), 2, F.size(marks)), F.array(F.size(lines) + 1))
            each = lambda m, end: F.struct(m["heading"].alias("heading"), F.slice(lines, m["at"] + 1, end - m["at"] - 1).alias("lines"))
            return F.filter(F.zip_with(marks, until, each), lambda b: F.size(b["lines"]) > 0)

        return once(F.concat(F.array(none), marks), cut)

    return once(lines_of(text), blocks)


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value) with value computed once, also where make uses it within other lambdas."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def term_chunks(text: Column, title: Column, p: ChunkParams = ChunkParams()) -> Column:
    """Texts of the term blocks under title and heading; a text with one block at most is taken whole."""
    whole = F.when(word_count(text) <= p.window, F.array(text)).otherwise(_prefixed(windows(text, p), F.concat(title, F.lit("\n"))))

    def one(block: Column) -> Column:
        prefix = F.concat(F.when(block["heading"].isNull(), title).otherwise(F.concat_ws(" — ", title, block["heading"])), F.lit("\n"))
        body = F.array_join(F.filter(block["lines"], lambda s: strip(s) != ""), "\n")
        return _prefixed(F.when(word_count(body) <= p.window, F.array(body)).otherwise(windows(body, p)), prefix)

    # Only texts with a heading line pay for the fold over their lines.
    blocks = F.when(text.rlike("(?m)" + TERM_HEADING.replace(r"\z", "$").replace(r"^\s*", r"^[^\S\n]*")), term_blocks(text))
    return F.when(F.coalesce(F.size(blocks), F.lit(0)) > 1, F.flatten(F.transform(blocks, one))).otherwise(whole)


def announcement_chunks(text: Column, title: Column, date: Column, p: ChunkParams = ChunkParams()) -> Column:
    """From the line that repeats the title on, or without the navigation lines at the top; the date once in front."""
    lines = filled_lines(text)
    same = F.transform(lines, lambda s: caseless(squeeze(s)) == caseless(squeeze(title)))
    at = F.array_position(same, True)
    first = F.array_position(F.transform(lines, lambda s: F.lower(strip(s)).isin(*NAVIGATION)), False)
    body = F.when(at > 0, F.slice(lines, at.cast("int"), F.size(lines))).when(first > 0, F.slice(lines, first.cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    plain = F.array_join(body, "\n")
    prefix = F.when(F.coalesce(date, F.lit("")) != "", F.concat(F.lit("["), date, F.lit("] "))).otherwise("")
    return F.when(word_count(F.concat(prefix, plain)) <= p.window, F.array(F.concat(prefix, plain))).otherwise(_prefixed(windows(plain, p), prefix))


def informative(text: Column, title: Column, unit: Column, kind: Column, p: ChunkParams = ChunkParams()) -> Column:
    """Whether a chunk says more than boiler-plate, its title and its unit: not a placeholder, and long enough unless
    it is about staff."""
    names = F.array(caseless(F.coalesce(title, F.lit(""))), F.coalesce(caseless(F.nullif(unit, F.lit(""))), F.lit("")))
    body = F.filter(F.transform(lines_of(text), strip), lambda s: (s != "") & ~boilerplate(s) & ~F.array_contains(names, caseless(s)))
    joined = F.array_join(body, " ")
    return (joined != "") & ~caseless(joined).isin(*PLACEHOLDERS) & ((kind == STAFF) | (word_count(joined) >= p.min_words))


def without_boilerplate(text: Column) -> Column:
    return strip(F.array_join(F.filter(lines_of(text), lambda s: ~boilerplate(s)), "\n"))


def chunk_texts(p: ChunkParams = ChunkParams()) -> Column:
    """The texts of a page record's chunks by its kind, before filters."""
    text, title, kind = F.col("text"), F.col("title"), F.col("doc_type")
    return (
        F.when(kind == STAFF, staff_chunks(text, title, p))
        .when(kind.isin(TABLE, PDF), term_chunks(text, title, p))
        .when(kind.isin(ANNOUNCEMENT, NEWS), announcement_chunks(text, title, F.col("published_at"), p))
        .otherwise(windows(text, p))
    )


def chunk_pages(pages: DataFrame, p: ChunkParams = ChunkParams(), keep: tuple[str, ...] = (), repair: bool = True) -> DataFrame:
    """Chunks of page records: chunk_id, n (place within the page), url, title, unit, doc_type, published_at, text,
    job_form, then the columns in keep. Texts shorter than min_chars are no chunks and take no number; chunks that say
    nothing go after numbering; boiler-plate lines are cut from the rest. Null texts and titles count as empty.
    Without repair, lines of single letters are words as they stand, not letters set apart."""
    text = F.coalesce("text", F.lit(""))
    fixed = pages.withColumns({"text": repair_spacing(text, p) if repair else text, "title": F.coalesce("title", F.lit(""))})
    marked = fixed.withColumn("job_form", is_job_form(F.col("text"), p))
    long = F.filter(F.transform(chunk_texts(p), strip), lambda t: F.length(t) >= p.min_chars)
    columns = ["url", "title", "unit", "doc_type", "published_at", "job_form", *keep]
    rows = marked.select(*columns, F.posexplode(long).alias("n", "text"))
    told = rows.filter(informative(F.col("text"), F.col("title"), F.col("unit"), F.col("doc_type"), p))
    key = F.substring(F.sha1(F.encode(F.concat_ws("#", "url", F.col("n").cast("string")), "UTF-8")), 1, 16)
    return told.select(key.alias("chunk_id"), "n", "url", "title", "unit", "doc_type", "published_at", without_boilerplate(F.col("text")).alias("text"), "job_form", *keep)


def profile(chunks: DataFrame) -> DataFrame:
    """Per kind and (null kind) overall: chunks, the least, mean (whole) and most words, and an example: the chunk with
    the smallest id."""
    n = chunks.withColumn("words", word_count(F.col("text")))
    return n.rollup("doc_type").agg(F.count("*").alias("n"), F.min("words").alias("least"), F.floor(F.avg("words")).alias("mean"), F.max("words").alias("most"), F.min("chunk_id").alias("example"))
