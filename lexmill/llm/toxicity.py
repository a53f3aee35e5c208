"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the embeddings of its hash and of the hashes of its first bytes, so that derived forms of
a known stem are known too. Filters of several widths slide over the whole text, their rectified maxima feed a logistic
unit. The decision threshold is calibrated for each language, which is guessed from the text's own function words, and
subtracted before the logistic function, so that 0.5 decides everywhere.

The model is fitted on every labelled row, by Spark jobs over a stored table of their features. Counts of features are
summed by bucket. Then come rounds: each task descends from the round's model over its own rows, and what it changed is
averaged by bucket over the tasks that changed it, weighed by their rows. Rows whose hash leaves 4 by 5 give no weights
but the thresholds, from counts of their scores by language. Neither rows nor embeddings pass through the driver: the
tables of odds and changes lie in the shared folder, where tasks read them, and `buckets` bounds their size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import ALNUM, append, column, filesystem, map_rows, pack, splitmix, table, unpack, whole_id, word_hashes
from lexmill.storage import discard, materialize

# Function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on be at by this are from or an",
    "fr": "le la les de des et un une du que est pour dans qui par sur avec au elle",
    "de": "der die das und den von zu mit ist des im nicht ein eine auf sich auch als",
    "es": "el la los las de y que en un una por con para del se su al lo como",
}


@dataclass(frozen=True)
class Params:
    prefixes: tuple[int, ...] = (4, 5)
    buckets: int = 22  # bits of a hash that pick an embedding
    least: int = 4  # labelled rows that a feature must occur in
    size: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 6
    batch: int = 64
    mixed: int = 1 << 20  # words that a task mixes at a time; with fewer a task, fewer tasks fit
    rate: float = 0.01
    embedding_rate: float = 0.05
    bins: int = 256  # of scores for each unit before the logistic function
    seed: int = 7


LONG, MOST = 1 << 15, 30  # words of a piece of a text; largest score before the logistic function


class Model:
    """Embeddings, filters, output weights and thresholds by guessed language. Embeddings follow from the odds of their
    buckets and the changes of all rounds: arrays, or tables in the shared folder that prepare reads."""

    def __init__(self, p: Params) -> None:
        self.p, rng = p, np.random.default_rng(p.seed)
        self.wide, n = max(p.widths), len(p.widths) * p.filters
        kernel, self.mask = np.zeros((self.wide * p.size, n)), np.zeros((self.wide * p.size, n))
        for i, w in enumerate(p.widths):
            own = slice(i * p.filters, (i + 1) * p.filters)
            kernel[: w * p.size, own] = rng.normal(0, 0.3, (w * p.size, p.filters))
            kernel[: w * p.size : p.size, own][:, : p.filters // 2] = 1.0 / w  # half of the filters begin by reading the first dimension
            self.mask[: w * p.size, own] = 1
        self.dense = np.concatenate([kernel.ravel(), np.zeros(n), np.full(n, 0.1), [-1.0]])  # filters, their bias, output, offset
        self.odds: tuple[np.ndarray, np.ndarray] | str | None = None  # buckets in order and their log odds, or a table
        self.changes: list[tuple[np.ndarray, np.ndarray]] | str | None = None
        self.thresholds = {k: 0.0 for k in (*FUNCTION_WORDS, "")}
        self.languages, marks = list(FUNCTION_WORDS), [word_hashes(v.encode(), ALNUM) for v in FUNCTION_WORDS.values()]
        self.marks = np.unique(np.concatenate(marks))
        self.marked = np.stack([np.isin(self.marks, x) for x in marks], axis=1)
        self.ready = False

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << self.p.buckets) - 1)).astype(np.int32)

    def parts(self, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        d, n = self.mask.shape
        return dense[: d * n].reshape(d, n), dense[d * n : d * n + n], dense[d * n + n : -1], dense[-1]

    def prepare(self) -> None:
        """Embeddings, made once a worker, and the table that gives a bucket's; embedding 0 is zero and stands for the
        unknown."""
        if self.ready:
            return
        p = self.p
        buckets, odds = read_columns(self.odds, "bucket", "odds") if isinstance(self.odds, str) else self.odds or (np.zeros(0, dtype=np.int64), np.zeros(0))
        order = np.argsort(buckets)
        self.rows = np.concatenate(([0], buckets[order]))
        self.table = np.zeros(1 << p.buckets, dtype=np.int32)
        self.table[self.rows] = np.arange(len(self.rows)) * (self.rows > 0)
        noise = splitmix((self.rows[:, None] * p.size + np.arange(p.size) + (p.seed << 40)).astype(np.uint64))
        self.embeddings = ((noise >> np.uint64(40)).astype(np.float32) / (1 << 24) - 0.5) * np.float32(0.17)
        self.embeddings[1:, 0] = np.clip(odds[order] / 4, -1, 1)
        self.embeddings[0] = 0
        if isinstance(self.changes, str):
            self.changes = read_columns(self.changes, "bucket", *(f"d{i}" for i in range(p.size)))
            self.changes = [(self.changes[0], np.stack(self.changes[1:], axis=1) / SCALE)]
        for rows, d in self.changes or []:
            self.embeddings[self.table[rows[rows > 0]]] += d[rows > 0].astype(np.float32)
        self.kernel, self.bias, self.out, self.offset = (np.float32(x) for x in self.parts(self.dense))
        self.ready = True

    def language(self, hashes: np.ndarray) -> str:
        at = np.searchsorted(self.marks, hashes)
        at[at == len(self.marks)] = 0
        counts = self.marked[at[self.marks[at] == hashes]].sum(axis=0)
        best = int(counts.argmax())
        return self.languages[best] if counts[best] else ""

    def logit(self, buckets: np.ndarray) -> float:
        """Of the buckets of a text (rows: words, prefixes), in pieces that overlap by the widest filter."""
        top, n = np.zeros(len(self.bias), dtype=np.float32), buckets.shape[1]
        for at in range(0, max(n, 1), LONG):
            ids = self.table[buckets[:, at : at + LONG + self.wide - 1]]
            known = np.flatnonzero(ids.any(axis=0))
            # Windows without a known word all look alike; the bias stands for them.
            near = np.unique(np.concatenate([known - k for k in range(self.wide)])) if len(known) else known
            near = near[near >= 0]
            x = np.zeros((ids.shape[1] + self.wide - 1, self.p.size), dtype=np.float32)
            x[known] = self.embeddings[ids[:, known]].sum(axis=0)
            if len(near):
                windows = np.concatenate([x[near + k] for k in range(self.wide)], axis=1)
                np.maximum(top, (windows @ self.kernel + self.bias).max(axis=0), out=top)
            if len(near) < max(ids.shape[1], 1):
                np.maximum(top, self.bias, out=top)
        return float(top @ self.out + self.offset)

    def score(self, text: bytes | None) -> float:
        hashes = word_hashes(text or b"", ALNUM, self.p.prefixes)
        z = self.logit(self.bucket(hashes)) - self.thresholds[self.language(hashes[0])]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


SCALE = 1 << 20  # changes are summed as whole numbers, so that sums do not depend on their order


def read_columns(uri: str, *names: str) -> list[np.ndarray]:
    """Columns of a table in the shared folder."""
    from pyarrow import parquet

    fs, path = filesystem(uri)
    found = parquet.read_table(path, columns=list(names), filesystem=fs)
    return [found[n].to_numpy() for n in names]


class Descent:
    """Descent over the logistic loss with classes weighed alike, from a model on: Adam over filters and output, steps
    by embedding scaled by its own gradients so far. Gradients reach embeddings through the windows that gave a filter
    its maximum."""

    def __init__(self, m: Model, totals: tuple[int, int], seed: int = 0) -> None:
        m.prepare()
        self.m, self.rng, self.seen, self.steps = m, np.random.default_rng((m.p.seed, seed)), 0, 0
        self.importance = np.array([0.5 * sum(totals) / max(t, 1) for t in totals])
        self.embeddings, self.squares, self.touched = m.embeddings.copy(), np.zeros(len(m.rows), dtype=np.float32), np.zeros(len(m.rows), dtype=bool)
        self.dense, self.moments = m.dense.copy(), (np.zeros_like(m.dense), np.zeros_like(m.dense))

    def run(self, rows: Iterable[tuple[np.ndarray, int]]) -> None:
        """Takes (buckets, label) rows, mixed within stretches of bounded size."""
        held, words = [], 0
        for buckets, label in rows:
            held.append((buckets, label))
            words += buckets.shape[1] + 16
            if words >= self.m.p.mixed:
                self.mix(held)
                held, words = [], 0
        self.mix(held)

    def mix(self, held: list[tuple[np.ndarray, int]]) -> None:
        order = self.rng.permutation(len(held)).tolist()
        for at in range(0, len(order), self.m.p.batch):
            some = [held[i] for i in order[at : at + self.m.p.batch]]
            self.step([self.m.table[b] for b, _ in some], np.array([y for _, y in some]))

    def peaks(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts given as numbers of embeddings: each filter's maximum, the window that gave it, and the numbers of
        embeddings in that window. Long texts go in pieces that overlap by the widest filter."""
        wide, found, owners, group, size = self.m.wide, [], [], [], 0
        for i, t in enumerate(texts):
            for at in range(0, max(t.shape[1], 1), LONG):
                owners.append(i)
                group.append(t[:, at : at + LONG + wide - 1])
                size += group[-1].shape[1]
                if size >= 2 * LONG:
                    found.append(self.windows(group))
                    group, size = [], 0
        if group:
            found.append(self.windows(group))
        top, windows, numbers = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(owners) > len(texts):
            first = np.searchsorted(owners, np.arange(len(texts) + 1))
            best = np.stack([a + top[a:b].argmax(axis=0) for a, b in zip(first[:-1], first[1:], strict=True)])
            n = np.arange(top.shape[1])
            top, windows, numbers = top[best, n], windows[best, n], numbers[best, n]
        return top, windows, numbers

    def windows(self, group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wide = self.m.wide
        kernel, bias, _, _ = self.m.parts(self.dense)
        lengths = np.array([max(t.shape[1], 1) for t in group])  # no word: a window of zeros
        starts = np.cumsum([0, *(lengths + wide - 1)])
        ids = np.zeros((group[0].shape[0], starts[-1]), dtype=np.int32)
        for t, a in zip(group, starts[:-1].tolist(), strict=True):
            ids[:, a : a + t.shape[1]] = t
        lengths = np.minimum(lengths, LONG)
        at = np.concatenate([np.arange(a, a + n) for a, n in zip(starts[:-1].tolist(), lengths.tolist(), strict=True)])
        x = self.embeddings[ids].sum(axis=0)
        windows = np.concatenate([x[at + k] for k in range(wide)], axis=1)
        y = windows @ kernel.astype(np.float32) + bias.astype(np.float32)
        top = np.maximum.reduceat(y, np.cumsum([0, *lengths[:-1]]), axis=0)
        owner = np.repeat(np.arange(len(group)), lengths)
        w, f = np.nonzero(y == top[owner])
        best = np.zeros(top.shape, dtype=np.int64)
        best[owner[w[::-1]], f[::-1]] = w[::-1]  # of equal maxima the first
        return top, windows[best], np.moveaxis(ids[:, at[best][..., None] + np.arange(wide)], 0, 2)

    def step(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        p, (kernel, _, out, offset) = self.m.p, self.m.parts(self.dense)
        top, windows, numbers = self.peaks(texts)
        pooled = np.maximum(top, 0)
        z = np.clip(pooled @ out + offset, -MOST, MOST)
        slope = (1 / (1 + np.exp(-z)) - labels) * self.importance[labels] / len(texts)
        back = slope[:, None] * out * (top > 0)
        grad = np.concatenate([(np.einsum("sf,sfd->df", back, windows) * self.m.mask).ravel(), back.sum(axis=0), slope @ pooled, [slope.sum()]])
        by_word = back[:, :, None, None] * kernel.T.reshape(1, -1, self.m.wide, p.size)
        shape = (*numbers.shape, p.size)  # text, filter, word or prefix, place in the window, dimension
        keys, parts = numbers.ravel(), np.broadcast_to(by_word[:, :, None], shape).reshape(-1, p.size)
        live = np.flatnonzero((keys > 0) & parts.any(axis=1))
        live = live[np.argsort(keys[live], kind="stable")]
        if len(live):
            keys = keys[live]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            rows, sums = keys[first], np.add.reduceat(parts[live], first, axis=0)
            self.squares[rows] += (sums**2).sum(axis=1)
            self.embeddings[rows] -= p.embedding_rate * sums / (np.sqrt(self.squares[rows]) + 1e-8)[:, None]
            self.touched[rows] = True
        self.steps, self.seen, (a, b) = self.steps + 1, self.seen + len(texts), self.moments
        a += 0.1 * (grad - a)
        b += 0.001 * (grad**2 - b)
        self.dense -= p.rate * (a / (1 - 0.9**self.steps)) / (np.sqrt(b / (1 - 0.999**self.steps)) + 1e-8)

    def changed(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and what was added to their embeddings; the other weights by `size` under -1, -2, ..."""
        size, rows = self.m.p.size, np.flatnonzero(self.touched)
        dense = self.dense - self.m.dense
        dense = np.concatenate([dense, np.zeros(-len(dense) % size)]).reshape(-1, size)
        return np.concatenate([self.m.rows[rows], -1 - np.arange(len(dense))]), np.concatenate([self.embeddings[rows] - self.m.embeddings[rows], dense])


def advance(m: Model, dense: dict[int, list[float]]) -> None:
    """Adds changes of the weights that are no embeddings (see Descent.changed)."""
    m.dense = m.dense + np.concatenate([dense[-1 - i] for i in range(len(dense))])[: len(m.dense)]


def odds_of(df: np.ndarray, toxic: np.ndarray, totals: tuple[int, int]) -> np.ndarray:
    return np.log((toxic + 0.5) / (totals[1] + 1)) - np.log((df - toxic + 0.5) / (totals[0] + 1))


def count(rows: Iterable[tuple[np.ndarray, int]], p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of (buckets, label) rows, the rows that each occurs in, and the toxic ones of them."""
    df, toxic = np.zeros(1 << p.buckets, dtype=np.int32), np.zeros(1 << p.buckets, dtype=np.int32)
    for buckets, label in rows:
        own = np.unique(buckets)
        df[own] += 1
        if label:
            toxic[own] += 1
    df[0] = 0  # embedding 0 stands for the unknown
    found = np.flatnonzero(df)
    return found, df[found], toxic[found]


def train(texts: list[np.ndarray], languages: list[str], labels: np.ndarray, p: Params) -> Model:
    """Fits a model on texts in memory given as buckets (rows: words, prefixes) with their guessed languages, as fit
    does in a single task. Every fifth text, in the given order, is kept for calibration."""
    m, rows = Model(p), list(zip(texts, np.asarray(labels).astype(int).tolist(), strict=True))
    kept = [r for i, r in enumerate(rows) if i % 5 != 4]
    totals = tuple(sum(y == k for _, y in kept) for k in (0, 1))
    if min(totals):
        buckets, df, toxic = count(kept, p)
        often = df >= p.least
        m.odds, m.changes = (buckets[often], odds_of(df, toxic, totals)[often]), []
        for r in range(p.epochs):
            d = Descent(m, totals, r)
            d.run(kept)
            buckets, changes = d.changed()
            m.changes.append((buckets, changes))
            advance(m, {k: v for k, v in zip(buckets.tolist(), changes, strict=True) if k < 0})
            m.ready = False
    m.prepare()
    _calibrate(m, [(languages[i], binned(m, t), y, 1) for i, (t, y) in enumerate(rows) if i % 5 == 4])
    return m


def binned(m: Model, buckets: np.ndarray) -> int:
    return int(np.floor(np.clip(m.logit(buckets), -MOST, MOST) * m.p.bins))


def _calibrate(m: Model, counts: list[tuple[str, int, int, int]]) -> None:
    """For each guessed language the threshold of the fewest errors, in the middle of its gap, from (language, bin of
    scores, label, rows); languages with few rows of a class take that of all rows."""
    languages, where, labels, n = (np.array(x) for x in zip(*counts, strict=True)) if counts else (np.zeros(0),) * 4

    def best(own) -> float:
        z, at = np.unique(where[own], return_inverse=True)
        toxic, clean = (np.bincount(at, weights=n[own] * (labels[own] == y), minlength=len(z)) for y in (1, 0))
        cost = np.concatenate(([0], np.cumsum(toxic))) + np.concatenate((np.cumsum(clean[::-1])[::-1], [0]))
        cuts = np.flatnonzero(cost == cost.min())
        k = int(cuts[len(cuts) // 2])
        low, high = (z[k - 1] if k else z[0] - m.p.bins), (z[k] if k < len(z) else z[-1] + m.p.bins)
        return float((low + high + 1) / 2 / m.p.bins)

    def fewest(own) -> int:
        return min((n[own] * (labels[own] == y)).sum() for y in (0, 1))

    everything = np.ones(len(labels), dtype=bool)
    everywhere = best(everything) if fewest(everything) else 0.0
    for k in m.thresholds:
        own = languages == k
        m.thresholds[k] = best(own) if fewest(own) >= 20 else everywhere


def features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, p: Params) -> DataFrame:
    """(label, held, language, words, buckets) of each row of docs whose id has a label and is not held out, stored;
    held rows give thresholds. Of several labels of an id the largest counts. Labels grow with the texts, so that the join
    is one of sorted shuffles at any size."""
    learned = F.pmod(F.crc32(column(id_col).cast("string").cast("binary")), F.lit(5)) != 0
    known = labels.filter(learned).filter(column(label_col).isin(0, 1)).select(whole_id(id_col).alias("doc_id"), column(label_col).cast("int").alias("label"))
    known = known.filter("doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    source = docs.filter(learned).select(whole_id(id_col).alias("doc_id"), column(text_col).cast("string").alias("text")).join(known.hint("merge"), "doc_id")
    held = F.pmod(F.xxhash64("doc_id", "text"), F.lit(5)) == 4

    def make():
        m = Model(p)

        def run(rows):
            for label, held, text in rows:
                hashes = word_hashes(text or b"", ALNUM, p.prefixes)
                yield label, held, m.language(hashes[0]), hashes.shape[1], m.bucket(hashes).T.tobytes()

        return run

    return materialize(map_rows(source.select("label", held.alias("held"), "text"), make, "label int, held boolean, language string, words long, buckets binary"), "features", compression="zstd")


def unstored(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[tuple[np.ndarray, int]]:
    for batch in batches:
        for buckets, label in zip(batch.column("buckets"), batch.column("label").to_pylist(), strict=True):
            yield np.frombuffer(buckets.as_buffer(), dtype=np.int32).reshape(-1, 1 + len(p.prefixes)).T, label


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", params: Params = Params()) -> Model:
    """A model from all labelled rows. Rows whose crc32(id as text) leaves no remainder by 5 are held out, and so are
    null labels."""
    p, m, context = params, Model(params), docs.sparkSession.sparkContext
    stored = features(docs, labels, id_col, text_col, label_col, p)
    told = {(r["held"], r["label"]): r for r in stored.groupBy("held", "label").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect()}
    totals = tuple(told[False, y]["n"] if (False, y) in told else 0 for y in (0, 1))
    if min(totals):
        tasks = 1 + sum(r["words"] for (held, _), r in told.items() if not held) // p.mixed
        rows = stored.filter("not held").select("label", "buckets").coalesce(tasks)

        def counted(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in count(unstored(batches, p), p)], ["bucket", "df", "toxic"])

        sums = rows.mapInArrow(counted, "bucket long, df long, toxic long").groupBy("bucket").agg(F.sum("df").alias("df"), F.sum("toxic").alias("toxic"))
        clean, toxic = F.col("df") - F.col("toxic") + 0.5, F.col("toxic") + 0.5
        odds = F.log(toxic / (totals[1] + 1)) - F.log(clean / (totals[0] + 1))
        m.odds = materialize(sums.filter(F.col("df") >= p.least).select("bucket", odds.alias("odds")), "odds")._lexmill_path
        names, before = [f"d{i}" for i in range(p.size)], None
        for r in range(p.epochs):
            model = context.broadcast(m)

            def descended(batches, model=model, r=r):
                from pyspark import TaskContext

                d = Descent(model.value, totals, (TaskContext.get().partitionId() << 8) + r)
                d.run(unstored(batches, p))
                if d.seen:
                    buckets, changes = d.changed()
                    whole = np.rint(changes * d.seen * SCALE).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(np.full(len(buckets), d.seen)), *(pa.array(whole[:, i].copy()) for i in range(p.size))], ["bucket", "n", *names])

            found = rows.mapInArrow(descended, f"bucket long, n long, {', '.join(f'{x} long' for x in names)}")
            mean = found.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).select("bucket", *[F.round(F.col(x) / F.col("n")).cast("long").alias(x) for x in names])
            changes = materialize(mean if before is None else mean.unionByName(before).groupBy("bucket").agg(*[F.sum(x).alias(x) for x in names]), "changes")
            discard(*[before] * (before is not None))
            dense = {k[0]: np.array(k[1:]) / SCALE for k in changes.filter("bucket < 0").select("bucket", *names).collect()}
            m.dense, m.changes, before = Model(p).dense, changes._lexmill_path, changes
            advance(m, dense)
            model.destroy()
    model = context.broadcast(m)

    def scored(rows):
        w = model.value
        w.prepare()
        for language, label, buckets in rows:
            yield language.decode(), label, binned(w, np.frombuffer(buckets, dtype=np.int32).reshape(-1, 1 + len(p.prefixes)).T)

    counts = map_rows(stored.filter("held").select("language", "label", "buckets"), lambda: scored, "language string, label int, bin long")
    _calibrate(m, [(r["language"], r["bin"], r["label"], r["n"]) for r in counts.groupBy("language", "bin", "label").agg(F.count("*").alias("n")).collect()])
    model.destroy()
    discard(stored)
    return m


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, params: Params = Params()) -> DataFrame:
    """The columns in keep (the id), then held_out, score and predicted, a row for each row of docs.

    Null and empty texts get the score of a text without known words. Without labels of both classes the model is
    constant. A null id is held out of nothing: held_out false. Labels are found by ids that are whole numbers. A kept
    column named like a new one is renamed (common.kept_names). Other columns are not read, and neither labels, language,
    source nor id is an input of a score.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, params=params))

    def make():
        m = model.value
        m.prepare()
        return lambda texts: [(s, int(s >= 0.5)) for s in map(m.score, texts)]

    keep = keep or (id_col,)
    held = F.coalesce(F.pmod(F.crc32(column(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    source = pack(docs, keep, column(text_col).alias("text"), held.alias("held_out"))
    return unpack(append(source, "text", make, "score double, predicted int", ["row", "held_out"]), keep, "held_out", "score", "predicted")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
