"""Benchmark decontamination as a prefix-filtered set join.

Every window of an item is a set of word shingles. Shingles are ordered by rarity over all documents; since a window
must be contained whole, its necessary prefix is its rarest shingle. Documents are joined with that prefix, the
shingle's place in the window and the document's length bound where the window could start, and the words there are
compared one by one. The prefix table is broadcast in blocks of at most max_windows windows, each block against all
documents, so that what is broadcast stays bounded for a benchmark of any size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import ALNUM, append, column, map_rows, ngrams, pack, signed, table, unpack, word_hashes
from lexmill.storage import materialize


@dataclass(frozen=True)
class Params:
    window: int = 10
    shingle: int = 3
    max_windows: int = 50_000  # windows (of at most `window` 8-byte words) in one broadcast


class Lookup:
    """A set of 64-bit hashes; a bitmap of their low bits answers most misses."""

    def __init__(self, keys: np.ndarray, bits: int = 20) -> None:
        self.keys, self.mask = np.unique(keys), np.uint64((1 << bits) - 1)
        self.bitmap = np.zeros(1 << bits, dtype=bool)
        self.bitmap[self.keys & self.mask] = True

    def places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of values that are keys, and which keys."""
        if not len(self.keys):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at = np.flatnonzero(self.bitmap[values & self.mask])
        key = np.minimum(np.searchsorted(self.keys, values[at]), len(self.keys) - 1)
        ok = self.keys[key] == values[at]
        return at[ok], key[ok]


def windows_of(items: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """(item, words): the distinct windows of each item as 64-bit word hashes. An item of fewer words is one window."""

    def run(rows):
        for item, text in rows:
            words = word_hashes(text or b"", ALNUM)
            n = min(p.window, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                yield item.decode(), words[i : i + n].tobytes()

    source = items.select(column(id_col).cast("string").alias("item"), column(text_col).cast("string").alias("text")).filter("item is not null")
    return map_rows(source, lambda: run, "item string, words binary").distinct()


def rarity(docs: DataFrame, text_col: str, keys: dict[int, np.ndarray]) -> dict[int, dict[int, int]]:
    """How often each shingle of the windows occurs in all documents, by shingle length."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def make():
        tables = {k: Lookup(v) for k, v in shared.value.items()}

        def run(rows):
            counts = {k: np.zeros(len(t.keys), dtype=np.int64) for k, t in tables.items()}
            for (text,) in rows:
                words = word_hashes(text or b"", ALNUM)
                for k, t in tables.items():
                    if len(words) >= k:
                        counts[k] += np.bincount(t.places(ngrams(words, k))[1], minlength=len(t.keys))
            for k, t in tables.items():
                for i in np.flatnonzero(counts[k]):
                    yield k, int(signed(t.keys)[i]), int(counts[k][i])

        return run

    found = map_rows(docs.select(column(text_col).cast("string")), make, "k int, shingle long, n long").groupBy("k", "shingle").agg(F.sum("n").alias("n"))
    out: dict[int, dict[int, int]] = {k: {} for k in keys}
    for k, s, n in found.collect():  # at most max_windows * window rows
        out[k][s & 0xFFFFFFFFFFFFFFFF] = n
    return out


def prefix_table(rows: list, docs: DataFrame, text_col: str, p: Params) -> dict:
    """By window length: the rarest shingle of each window, its place in the window, the words and the item."""
    names = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(names)}
    by_length: dict[int, list] = {}
    for item, words in rows:
        by_length.setdefault(len(words) // 8, []).append((number[item], words))
    words = {n: np.frombuffer(b"".join(w for _, w in v), dtype=np.uint64).reshape(-1, n) for n, v in by_length.items()}
    grams = {n: np.stack([ngrams(w, p.shingle) for w in m]) for n, m in words.items()}
    keys: dict[int, np.ndarray] = {}
    for n, g in grams.items():
        k = min(p.shingle, n)
        keys[k] = np.union1d(keys.get(k, np.empty(0, dtype=np.uint64)), g.ravel())
    counts = rarity(docs, text_col, keys)
    table = {}
    for n, g in grams.items():
        have = counts[min(p.shingle, n)]
        often = np.array([[have.get(int(x), 0) for x in row] for row in g])
        offset = np.lexsort((g, often), axis=1)[:, 0]
        prefix = g[np.arange(len(g)), offset]
        order = np.argsort(prefix, kind="stable")
        table[n] = tuple(x[order] for x in (prefix, offset, words[n], np.array([i for i, _ in by_length[n]])))
    return {"items": names, "windows": table}


def matches(words: np.ndarray, table: dict, lookups: dict[int, Lookup], shingle: int) -> tuple[list[tuple[int, int]], set[int]]:
    """Spans of document words that windows cover, and the items with occurring windows."""
    spans, items = [], set()
    for n, (prefix, offset, content, item) in table.items():
        if len(words) < n:
            continue
        at, key = lookups[n].places(ngrams(words, min(shingle, n)))
        if not len(at):
            continue
        low, high = (np.searchsorted(prefix, lookups[n].keys[key], side=s) for s in ("left", "right"))
        for a in range(0, len(at), 4096):  # candidates in pieces of bounded size
            reps = (high - low)[a : a + 4096]
            which = np.repeat(low[a : a + 4096], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            start = np.repeat(at[a : a + 4096], reps) - offset[which]
            inside = (start >= 0) & (start + n <= len(words))
            which, start = which[inside], start[inside]
            for i in range(n):  # verification, word by word
                same = words[start + i] == content[which, i]
                which, start = which[same], start[same]
            items.update(np.unique(item[which]).tolist())
            spans += [(int(s), int(s) + n) for s in np.unique(start)]
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", params: Params = Params()) -> DataFrame:
    """The columns in keep, then hit_words long, hit_starts and hit_ends array<int> (merged spans of hit words, end
    exclusive) and hit_items array<string> (sorted). A row for each row of docs.

    Null and empty texts have no words and no hits. Items without an id or without words are passed over. Repeated
    items and windows count once. A kept column named like a new one is renamed (common.kept_names). Other columns are
    not read.
    """
    p = params
    windows = materialize(windows_of(benchmark, item_id, item_text, p), "windows")
    blocks = max(1, -(-windows.count() // p.max_windows))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int"))
    state = ["hit_words", "hit_starts", "hit_ends", "hit_items"]
    out = pack(docs, keep, column(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias(state[0]), F.expr("cast(array() as array<int>)").alias(state[1]), F.expr("cast(array() as array<int>)").alias(state[2]), F.expr("cast(array() as array<string>)").alias(state[3]))
    for k in range(blocks):
        rows = [(r["item"], bytes(r["words"])) for r in windows.filter(F.col("block") == k).collect()]  # about max_windows
        table = docs.sparkSession.sparkContext.broadcast(prefix_table(rows, docs, text_col, p))

        def make(table=table):
            items, windows = table.value["items"], table.value["windows"]
            lookups = {n: Lookup(x[0]) for n, x in windows.items()}

            def run(texts):
                rows = []
                for text in texts:
                    words = word_hashes(text or b"", ALNUM)
                    spans, found = matches(words, windows, lookups, p.shingle)
                    spans = merged(spans)
                    rows.append((len(words), [a for a, _ in spans], [b for _, b in spans], sorted(items[i] for i in found)))
                return rows

            return run

        if blocks == 1:
            return unpack(append(out, "text", make, "hit_words long, hit_starts array<int>, hit_ends array<int>, hit_items array<string>", ["row"]), keep, *state)
        out = append(out, "text", make, "w long, s array<int>, e array<int>, i array<string>", ["row", "text", *state])
        out = out.select("row", "text", F.col("w").alias(state[0]), F.concat(state[1], "s").alias(state[1]), F.concat(state[2], "e").alias(state[2]), F.array_sort(F.array_union(state[3], "i")).alias(state[3]))
    # Spans of several blocks may overlap: merge them in order of their starts.
    pairs = F.array_sort(F.arrays_zip(F.col(state[1]).alias("a"), F.col(state[2]).alias("b")))
    spans = F.aggregate(pairs, F.expr("cast(array() as array<struct<a:int,b:int>>)"), lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(F.struct(x["a"].alias("a"), x["b"].alias("b"))))))
    out = out.withColumn("spans", spans)
    return unpack(out.select("row", state[0], F.col("spans.a").alias(state[1]), F.col("spans.b").alias(state[2]), state[3]), keep, *state)


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate(F.zip_with("hit_starts", "hit_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return hits.select("doc_id", F.col("hit_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_items") > 0).alias("contaminated"))


OP7_SQL = r"""
with words as (
  select 'd' k, doc_id::varchar id, text from documents union all select 'b', item_id::varchar, text from benchmark),
w as materialized (
  select k, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from words),
size as (select *, least(10, len(ws)) n from w where k = 'b' and len(ws) > 0),
win as materialized (
  select distinct id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) g from size),
lens as (select distinct n from size),
grams as (
  select w.id, lens.n, unnest(range(1, len(ws) - lens.n + 2)) pos, unnest(list_transform(range(1, len(ws) - lens.n + 2), lambda i: array_to_string(ws[i:i + lens.n - 1], ' '))) g
  from w, lens where w.k = 'd' and len(ws) >= lens.n),
hits as materialized (select g.id, g.n, g.pos, win.id item from grams g join win on win.g = g.g and win.n = g.n),
covered as (select id, count(distinct p) n_hit from (select id, unnest(range(pos, pos + n)) p from hits) group by 1),
items as (select id, count(*) n_items, string_agg(item, ',' order by item) s from (select distinct id, item from hits) group by 1)
select d.doc_id, len(w.ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from documents d join w on w.k = 'd' and w.id = d.doc_id::varchar left join covered c on c.id = w.id left join items i on i.id = w.id
"""
