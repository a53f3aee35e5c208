"""MinHash near-dedup with SetSketch registers.

A document's set holds the hashes of its distinct word shingles. Each register of a sketch is the truncated,
exponentially spaced minimum of one hash function over the set, so that sketches of parts merge by maximum and equal
registers are about as likely as shared shingles. Bands of registers propose pairs, the joint likelihood of two
sketches discards those that cannot reach the similarity asked for, and full sets confirm the rest. A set holds 64-bit
hashes of its shingles; two shingles of one document's pair agree by chance once in about 10^19 pairs.

Sizes: equal sets collapse to one class first. In a bucket of a band, each class is compared with one hub; what the
confirmed links join needs no further comparison. Only buckets that still hold several components compare members
across components. In the large ones of these, shingles that no other component holds bound what a member can share:
members that reach no other's size go, so that unlike documents around a common passage are not compared. The others
are compared in cells of bounded size: members outside a bucket's largest component with each other and with those
inside. A cell confirms on full sets and emits no more links than join its members.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import SPACED, column, constants, fingerprint, map_rows, ngrams, pack, signed, splitmix, table, unpack, whole_id, word_hashes
from lexmill.storage import discard, materialize


@dataclass(frozen=True)
class Params:
    shingle: int = 4
    similarity: tuple[int, int] = (80, 100)  # intersection / union >= first / second
    bands: int = 32
    base: float = 1.001
    scale: float = 20.0
    slack: float = 18.0  # log-likelihood by which a pair must miss the similarity to be discarded unverified
    cell: int = 512  # members of a bucket that one cell compares with as many others
    cell_shingles: int = 1 << 19  # and their shingles, about

    @property
    def registers(self) -> int:
        return 4 * self.bands


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; empty without words."""
    return np.unique(ngrams(word_hashes(text or b"", SPACED), k))


def sketch(items: np.ndarray, p: Params) -> np.ndarray:
    """SetSketch registers (uint16) of a non-empty set."""
    factors = constants(41, p.registers)
    least = np.full(p.registers, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(items), 1024):
        np.minimum(least, (items[at : at + 1024, None] * factors).min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300) / p.scale) / math.log(p.base)), 0, 65534).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, p: Params) -> np.ndarray:
    """Whether each pair of sketches (rows of uint16) may reach the similarity, by the joint likelihood of the numbers
    of registers that are larger in a, larger in b, and equal, given both set sizes."""
    goal = p.similarity[0] / p.similarity[1]
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)

    def likelihood(j):
        j = np.minimum(j, top)
        step = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (p.base - 1) / p.base) / math.log(p.base)
        up, down = step(u - v * j), step(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    best = np.max([likelihood(j) for j in np.linspace(0, 1, 41)], axis=0)
    at_goal = np.max([likelihood(j) for j in np.linspace(goal, 1, 9)], axis=0)
    return (top >= goal - 1e-9) & (at_goal >= best - p.slack)


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (u, v). Labels hook to neighbours' labels and jump to
    their labels' labels, so that rounds grow with the logarithm of the longest path."""
    both = materialize(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("id")).agg(F.min(F.least("u", "v")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), F.col("component").alias("cv")), "v").join(labels.select(F.col("id").alias("u"), F.col("component").alias("cu")), "u")
        offers = near.select(F.explode(F.array("u", "cu")).alias("id"), F.col("cv").alias("offer")).groupBy("id").agg(F.min("offer").alias("offer"))
        lower = labels.join(offers, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("offer", "component")).alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))
        new = materialize(lower.join(jump, "mid", "left").select("id", F.least("mid", F.coalesce("far", "mid")).alias("component"), "old"), "labels")
        moved = new.filter("component <> old").limit(1).count()
        discard(labels)
        labels = new
        if not moved:
            discard(both)
            return labels.select("id", "component")


def cell_links(p: Params):
    """mapInArrow over rows of cells, each cell's rows together: links (u, v) between members of different components
    that the likelihood lets through and the full sets confirm. Likelihoods are computed for many cells at once; what a
    link joins is not compared further."""

    def run(batches):
        import pyarrow as pa

        held, weight = [], 0
        for batch in batches:
            for part in slices(batch):
                held.append(part)
                weight += part.nbytes
            if weight >= 4 << 20 or sum(x.num_rows for x in held) >= 4096:
                whole = pa.Table.from_batches(held).combine_chunks()
                last = borders(whole)[-1]
                if last:
                    yield from links(whole.slice(0, last))
                held = whole.slice(last).to_batches()
                weight = sum(x.nbytes for x in held)
        if held:
            yield from links(pa.Table.from_batches(held).combine_chunks())

    def slices(batch):
        return [batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)]

    def borders(table) -> np.ndarray:
        """Where cells begin."""
        keys = [table.column(c).to_numpy() for c in ("band", "bucket", "i", "j", "across")]
        new = np.zeros(table.num_rows, dtype=bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        return np.flatnonzero(new)

    def links(table):
        import pyarrow as pa

        column = lambda c: table.column(c).to_numpy()
        starts = borders(table)
        band, across, major, block, i, j, rep, part, n, c = (column(x) for x in ("band", "across", "major", "block", "i", "j", "rep", "component", "n", "c"))
        part = part.copy()
        words = np.asarray(table.column("sketch").combine_chunks().flatten()).reshape(len(rep), -1)
        regs, sets = words.view(np.uint16).reshape(len(rep), -1), table.column("items")
        found: list[tuple[int, int]] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def settle():
            x, y = (np.concatenate(side) for side in zip(*pairs, strict=True))
            most = np.minimum(c[x], c[y])  # shingles that the two may share
            ok = p.similarity[1] * most >= p.similarity[0] * (n[x] + n[y] - most)
            x, y = x[ok], y[ok]
            equal = (words[x] == words[y]) & (np.arange(words.shape[1]) < band[x][:, None])
            ok = ~equal.any(axis=1) & (part[x] != part[y])  # a pair is looked at in its first common band only
            x, y = x[ok], y[ok]
            if not len(x):
                return
            ok = possible(regs[x], regs[y], n[x].astype(float), n[y].astype(float), p)
            x, y = x[ok], y[ok]
            shared = common(x, y)
            ok = p.similarity[1] * shared >= p.similarity[0] * (n[x] + n[y] - shared)
            x, y = x[ok], y[ok]
            _, first = np.unique(np.stack((part[x], part[y])), axis=1, return_index=True)
            for a, b in zip(x[first].tolist(), y[first].tolist(), strict=True):
                if part[a] != part[b]:
                    part[part == max(part[a], part[b])] = min(part[a], part[b])
                    found.append((min(int(rep[a]), int(rep[b])), max(int(rep[a]), int(rep[b]))))

        def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Sizes of the intersections of members x with members y, pairs of one cell after the other. A cell with
            many pairs for a member gets an index from shingles to members."""
            out, cell = np.zeros(len(x), dtype=np.int64), np.searchsorted(starts, x, side="right")
            for a, b in runs(cell):
                members, at = np.unique(y[a:b], return_inverse=True)
                values = owners = None
                if b - a > 4 * len(members):
                    values = np.concatenate([items_of(k) for k in members.tolist()])
                    owners = np.repeat(np.arange(len(members)), n[members])
                    order = np.argsort(values, kind="stable")
                    values, owners = values[order], owners[order]
                for c, d in runs(x[a:b]):
                    own = items_of(int(x[a + c]))
                    if values is None:
                        for k in range(a + c, a + d):
                            other = items_of(int(y[k]))
                            out[k] = (other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own).sum()
                        continue
                    low, high = (np.searchsorted(values, own, side=side) for side in ("left", "right"))
                    reps = high - low
                    places = np.repeat(low - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum())
                    out[a + c : a + d] = np.bincount(owners[places], minlength=len(members))[at[c:d]]
            return out

        def runs(keys: np.ndarray):
            edges = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)])) if len(keys) else [0]
            return zip(edges[:-1], edges[1:], strict=True)

        def items_of(k: int) -> np.ndarray:
            return np.frombuffer(sets[k].as_buffer(), dtype=np.uint64)

        for a, b in zip(starts, [*starts[1:], len(rep)], strict=True):
            here = np.arange(a, b)
            left, right = (here[~major[a:b]], here[major[a:b]]) if across[a] else (here[block[a:b] == i[a]], here[block[a:b] == j[a]])
            step = max(1, 32768 // max(1, len(right)))
            for at in range(0, len(left), step):
                x, y = (g.ravel() for g in np.meshgrid(left[at : at + step], right, indexing="ij"))
                ok = part[x] != part[y]
                if not across[a] and i[a] == j[a]:
                    ok &= x < y
                if ok.any():
                    pairs.append((x[ok], y[ok]))
                    size += int(ok.sum())
                if size >= 32768:
                    settle()
                    pairs, size = [], 0
        if pairs:
            settle()
        if found:
            u, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def lone_shingles(members: DataFrame, items: DataFrame) -> DataFrame:
    """(rep, lone): how many shingles of a member no other component among members(rep, component) holds, counted where
    at most two of its own component hold them; what is not counted bounds less."""

    def explode(batches):
        import pyarrow as pa

        for batch in batches:
            for rep, part, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                values = np.frombuffer(held.as_buffer(), dtype=np.int64)
                for at in range(0, len(values), 1 << 16):
                    some = values[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), rep)), pa.array(np.full(len(some), part))], names=["shingle", "rep", "part"])

    held = members.join(items, "rep").select("rep", "component", "items").mapInArrow(explode, "shingle long, rep long, part long")
    ends = held.groupBy("shingle").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.min("rep").alias("r0"), F.max("rep").alias("r1"), F.count("*").alias("m"))
    alone = ends.filter("p0 = p1 and m <= 2").select(F.explode(F.array_distinct(F.array("r0", "r1"))).alias("rep"))
    return alone.groupBy("rep").agg(F.count("*").alias("lone"))


def within_reach(placed: DataFrame, items: DataFrame, p: Params) -> DataFrame:
    """placed(rep, band, bucket, n, component) with c, the most shingles that a member may share with one of another
    component, and without the members of large unsettled buckets that can link with no other there.

    With at most c shingles in common, a member of n links with none larger than (a + b) c / a - n or smaller than
    a n / b, for a similarity of a / b. Sizes are compared in steps of six per cent, so that a member looks at a few
    steps of its bucket, not at the members."""
    a, b = p.similarity
    key = ["band", "bucket"]
    unsettled = placed.groupBy(*key).agg(F.count("*").alias("m"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter((F.col("m") > p.cell) & (F.col("c0") < F.col("c1"))).select(*key)
    large = placed.join(unsettled, key, "left_semi")
    lone = lone_shingles(large.select("rep", "component").distinct(), items)
    step = lambda n: F.floor(F.log(n.cast("double")) / math.log(1.06)).cast("int")
    bounded = large.join(lone, "rep", "left").withColumn("c", F.col("n") - F.coalesce("lone", F.lit(0))).drop("lone")
    bounded = bounded.withColumn("top", F.floor(F.col("c") * (a + b) / a) - F.col("n")).withColumn("low", F.ceil(F.col("n") * a / b)).filter("top >= low")
    bounded = materialize(bounded.withColumn("step", step(F.col("n"))), "bounded")
    steps = bounded.groupBy(*key, "step").agg(F.max("top").alias("far"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    near = bounded.select(*bounded.columns, F.explode(F.sequence(step(F.col("low")), step(F.col("top")))).alias("to"))
    met = near.join(steps.select(*key, F.col("step").alias("to"), "far", "c0", "c1"), [*key, "to"])
    met = met.filter("far >= n and (c0 <> component or c1 <> component)")
    columns = ["rep", *key, "n", "component", "c"]
    kept = met.select(*columns).distinct()
    rest = placed.join(unsettled, key, "left_anti").withColumn("c", F.col("n")).select(*columns)
    return rest.unionByName(kept)


def components(docs: DataFrame, id_col: str, text_col: str, p: Params, nameless: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, classes). rows: (doc_id, th, n, f1, f2, sketch) for each row, th a hash of its text. classes: the class
    (f1, f2, n) of each set that is not empty, with first_id and first_th of the row that comes first in its component,
    by id, rows without one last, then by th. Rows without an id take part if nameless."""

    def signatures():
        seen: dict[tuple, list] = {}

        def run(rows):
            for key, th, text in rows:
                items = shingle_set(text, p.shingle)
                if not len(items):
                    yield key, th, 0, 0, 0, None
                    continue
                f1, f2 = int(signed(splitmix(items + np.uint64(77)).sum(keepdims=True))[0]), int(signed(np.bitwise_xor.reduce(splitmix(items + np.uint64(99)), keepdims=True))[0])
                if (f1, f2) not in seen:
                    if len(seen) >= 2048:
                        seen.clear()
                    seen[f1, f2] = sketch(items, p).view(np.int64).tolist()
                yield key, th, len(items), f1, f2, seen[f1, f2]

        return run

    text = column(text_col).cast("string")
    source = docs.select(whole_id(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    signed_docs = materialize(map_rows(source, signatures, "doc_id long, th long, n long, f1 long, f2 long, sketch array<long>"), "signatures")
    # A class has a number of its own: a repeated id may stand on rows with different texts, or on none.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    classes = signed_docs.filter("n > 0").filter(F.lit(nameless) | F.col("doc_id").isNotNull()).groupBy("f1", "f2", "n").agg(first, F.first("sketch").alias("sketch"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    # Buckets of bands. Hubs differ between bands: the least number after a fixed exclusive-or mask of the band.
    masks = F.array(*[F.lit(int(x)) for x in constants(57, p.bands) >> np.uint64(2)])
    rows = classes.select("rep", "n", F.posexplode("sketch").alias("band", "bucket"))
    turned = F.col("rep").bitwiseXOR(F.get(masks, F.col("band")))
    hubs = rows.groupBy("band", "bucket").agg(F.min(turned).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    hubs = hubs.withColumn("hub", F.col("hub").bitwiseXOR(F.get(masks, F.col("band"))))
    shared = materialize(rows.join(hubs, ["band", "bucket"]), "buckets")

    needed = classes.join(shared.select("rep").distinct(), "rep", "left_semi")
    needed = needed.select(F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th"), "rep", F.col("f1").alias("own"))
    first_text = source.join(needed, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th"))).select("rep", "own", "text")

    def sets():
        def run(rows):
            for rep, own, text in rows:
                items = shingle_set(text, p.shingle)
                if len(items) and int(signed(splitmix(items + np.uint64(77)).sum(keepdims=True))[0]) == own:
                    yield rep, items.tobytes()

        return run

    items = materialize(map_rows(first_text, sets, "rep long, items binary").dropDuplicates(["rep"]), "sets")
    sketches = classes.select("rep", "n", "sketch")

    def likely(pairs: DataFrame) -> DataFrame:
        sides = [sketches.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in ("u", "v")]
        joined = pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "nu", "nv", "su", "sv")

        def keep(batches):
            for b in batches:
                if b.num_rows:
                    a, c = (np.asarray(b.column(i).flatten()).view(np.uint16).reshape(b.num_rows, -1) for i in (4, 5))
                    ok = possible(a, c, b.column(2).to_numpy().astype(float), b.column(3).to_numpy().astype(float), p)
                    yield b.select(["u", "v"]).filter(ok)

        return joined.mapInArrow(keep, "u long, v long")

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = p.similarity
        joined = pairs.join(items.select(F.col("rep").alias("u"), F.col("items").alias("iu")), "u").join(items.select(F.col("rep").alias("v"), F.col("items").alias("iv")), "v").select("u", "v", "iu", "iv")

        def run(rows):
            for u, v, iu, iv in rows:
                x, y = np.frombuffer(iu, dtype=np.uint64), np.frombuffer(iv, dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if b * common >= a * (len(x) + len(y) - common):
                    yield u, v

        return map_rows(joined, lambda: run, "u long, v long")

    # First links: each member with its bucket's hub.
    stars = shared.filter("rep <> hub").select(F.least("rep", "hub").alias("u"), F.greatest("rep", "hub").alias("v")).distinct()
    first = materialize(confirmed(likely(stars)), "links")
    parts = connected(first)

    # What is left: buckets that still hold several components. Members of the largest one (major) need not be compared
    # with each other.
    own = lambda df: df.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = own(shared.select("rep", "band", "bucket", "n"))  # one row a member and band
    placed = within_reach(materialize(placed, "placed"), items, p)
    held = placed.groupBy("band", "bucket", "component").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    count = lambda m, s: F.greatest(F.ceil(m / p.cell), F.ceil(s / p.cell_shingles), F.lit(1)).cast("int")
    most = F.max(F.struct("m", "s", "component"))
    split = held.groupBy("band", "bucket").agg(most.alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s")).filter(F.col("m") > F.col("top.m"))
    split = split.select("band", "bucket", F.col("top.component").alias("largest"), count(F.col("top.m"), F.col("top.s")).alias("majors"), count(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("minors"))
    cells = placed.join(split, ["band", "bucket"]).withColumn("major", F.col("component") == F.col("largest"))
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("major"), F.col("majors")).otherwise(F.col("minors"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    among = F.transform(upto(F.col("minors")), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j"), F.lit(False).alias("across")))
    across = F.transform(upto(F.col("majors")), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"), F.lit(True).alias("across")))
    inside = F.transform(upto(F.col("minors")), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(True).alias("across")))
    cells = cells.withColumn("block", block).withColumn("cell", F.explode(F.when(F.col("major"), inside).otherwise(F.concat(among, across))))
    key = ["band", "bucket", "i", "j", "across"]
    cells = cells.select("rep", "band", "bucket", "cell.*", "major", "block", "component", "n", "c").join(sketches.drop("n"), "rep").join(items, "rep")
    cells = cells.select(*key, "major", "block", "rep", "component", "n", "c", "sketch", "items")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = cells.repartition(width, *key).sortWithinPartitions(*key).mapInArrow(cell_links(p), "u long, v long")
    second = materialize(rest, "links")
    ends = connected(own(second.select(F.col("u").alias("rep"), "v")).select(F.col("component").alias("u"), F.col("v").alias("rep")).transform(own).select("u", F.col("component").alias("v")))
    discard(shared, items, first, second)

    whole = classes.select("f1", "f2", "n", "rep", "first").join(parts.select(F.col("id").alias("rep"), F.col("component").alias("c1")), "rep", "left")
    whole = whole.withColumn("c1", F.coalesce("c1", "rep")).join(ends.select(F.col("id").alias("c1"), F.col("component").alias("c2")), "c1", "left")
    whole = materialize(whole.select("f1", "f2", "n", "first", F.coalesce("c2", "c1").alias("component")), "components")
    # Only components of several classes look for their first row.
    firsts = whole.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("m")).filter("m > 1").drop("m")
    named = whole.join(firsts, "component", "left").withColumn("first", F.coalesce("least", "first"))
    named = materialize(named.select("f1", "f2", "n", F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th")), "firsts")
    discard(classes, whole)
    return signed_docs, named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    Null, empty and blank texts have no shingles and are linked with nothing. Repeated rows and equal sets share a
    component. Rows with one id and different texts are linked each by its own text. Rows without an id, or whose id is no whole number, take part in no
    link: component null, kept false. Other columns are not read.
    """
    rows, classes = components(docs, id_col, text_col, params, nameless=False)
    linked = rows.select("doc_id", "f1", "f2", "n").join(classes.drop("first_th"), ["f1", "f2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first_id", "doc_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def first_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """The rows of docs, all columns, that near-dedup leaves: one of each component, that with the smallest id, rows
    without an id last, then by a hash of the text; of rows that agree in both that with the least hash of all columns.

    Rows without an id, or whose id is no whole number, or with a repeated one take part like any other, each by its own
    text. Texts without words are linked with nothing: all their rows stay. Columns may have any name and type.
    """
    rows, classes = components(docs, id_col, text_col, params, nameless=True)
    firsts = classes.select("first_id", "first_th").distinct()
    again = rows.filter("n > 0").groupBy("doc_id", "th").agg(F.count("*").alias("m")).filter("m > 1")
    match = lambda a, b: F.col(a).eqNullSafe(F.col("first_id")) & (F.col(b) == F.col("first_th"))
    several = materialize(firsts.join(again, match("doc_id", "th"), "left_semi"), "repeats")
    other = several.select(F.col("first_id").alias("a"), F.col("first_th").alias("b"))
    single = materialize(firsts.join(other, match("a", "b"), "left_anti"), "singles")
    text = column(text_col).cast("string")
    spoken = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = pack(docs, docs.columns, whole_id(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), spoken.alias("spoken"), fingerprint(docs, docs.columns).alias("print"))
    one = keyed.join(single, match("doc_id", "th"), "left_semi").select("row")
    least = keyed.join(several, match("doc_id", "th"), "left_semi").groupBy("doc_id", "th").agg(F.min_by("row", "print").alias("row")).select("row")
    return unpack(one.unionByName(least).unionByName(keyed.filter(~F.col("spoken")).select("row")), docs.columns)


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Shingle overlaps counted exactly, links closed by recursion.
OP1_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as materialized (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) g from w),
n as materialized (select doc_id, count(*) n from s group by 1),
pairs as materialized (select a.doc_id u, b.doc_id v, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as materialized (select u, v from pairs join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)),
reach as (select doc_id a, doc_id b from documents union select r.a, l.v from reach r join links l on l.u = r.b),
comp as (select a, min(b) component_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, component_id, d.doc_id = component_id kept
from documents d left join n using (doc_id) join comp on comp.a = d.doc_id
"""
