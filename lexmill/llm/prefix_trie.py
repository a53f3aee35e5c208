"""The prefix trie of conversations from chained digests.

Conversations are rebuilt, each turn is digested once, and every prefix of a conversation gets a digest chained over its
turns. Exploding all prefixes and grouping them by depth and digest gives the nodes. A node is known by its smallest
member and its depth, so each node stands on one row of that member's prefixes, and the prefixes above it are all its
ancestors: what nodes add to their ancestors is summed from below within a conversation first and then by digest. No
node meets its ancestors pair by pair, and long conversations cost no more than their turns.

Sizes: turns are numbered by a range sort and counts of its partitions, chains and sums run over blocks of turns, and a
parent of very many children is handed to them by a broadcast of at most `hot` rows. A conversation, a first turn, or
one ending of any share of the rows is spread like all others. Texts are shuffled once, to be ordered.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import column, map_rows, table, whole_id
from lexmill.storage import discard, materialize

ROOT = hashlib.sha256(b"root").digest()[:16]


@dataclass(frozen=True)
class Params:
    block: int = 1024  # turns that one chain or one running sum holds
    hot: int = 1000  # parents with more than one child in so many go by broadcast: fewer than this can be
    chunk: int = 4096  # ids of one ending that are digested as one piece


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its five."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def numbered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, bytes): the turns of each conversation from 0 by turn, null first; turns with one number
    by role, then text. A turn's digest covers role and text, null as empty; bytes are those of the text."""
    blank = lambda c: F.coalesce(column(c).cast("string"), F.lit(""))
    rows = conversations.select(whole_id(conv_id).alias("conv_id"), column(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text")).filter("conv_id is not null")
    # Equal keys share a partition, so that a part of the text will do as a bound.
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")

    def digests():
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def run(rows):
            last, i = None, 0
            for c, r, t in rows:
                last, i = c, i + 1 if c == last else 0
                yield c, part, i, hashlib.sha256(len(r).to_bytes(8, "big") + r + t).digest()[:16], len(t)

        return run

    local = materialize(map_rows(ranged.select("conv_id", "role", "text"), digests, "conv_id long, part int, i long, digest binary, bytes long"), "turns")
    # Only conversations that lie across borders of partitions need an offset: at most two rows a partition.
    counts = local.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    across = counts.withColumn("before", before).filter("before is not null").select("conv_id", "part", "before")
    out = local.join(F.broadcast(across), ["conv_id", "part"], "left").select("conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "bytes")
    out._lexmill_path = local._lexmill_path
    return out


def rebuilt(turns: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns). conversations: (conv_id, total turns). turns: (conv_id, depth from 1, digest, bytes,
    total): first the first turns of the conversation's base, then its own after as many."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = (F.col("conv_id") - F.col("conv_id") % 5).alias("base")
    convs = sizes.select("conv_id", "n", base, shared_turns(F.col("conv_id")).alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.withColumn("m", taken).withColumn("total", taken + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "base", "n", "h", "m", "total"), "conversations")
    heads = turns.filter("conv_id % 5 = 0 and pos < 8").select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    first = convs.filter("m > 0").join(heads, "base").filter("pos < m").select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "bytes", "total")
    # A conversation meets its turns block by block.
    blocks = convs.filter("n > h").select("conv_id", "h", "m", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {p.block}"))).alias("block"))
    own = turns.withColumn("block", F.expr(f"pos div {p.block}")).join(blocks, ["conv_id", "block"]).filter("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("m") + 1).alias("depth"), "digest", "bytes", "total")
    return convs, first.unionByName(own)


def prefixes(turns: DataFrame, p: Params) -> DataFrame:
    """(conv_id, depth, digest, parent, bytes, last): every prefix of every conversation by a digest of its turns.

    The digest of a prefix is that of the state at its block's start and of the block's turns so far; the state at the
    next block's start is the digest of the last prefix before it. Blocks of long conversations are digested side by
    side, their states by one pass over the blocks."""
    placed = turns.withColumn("block", F.expr(f"(depth - 1) div {p.block}"))

    def contents(rows):
        key = running = None
        for c, b, _, d in rows:
            if (c, b) != key:
                if key:
                    yield *key, running.digest()
                key, running = (c, b), hashlib.sha256()
            running.update(d)
        if key:
            yield *key, running.digest()

    def states(rows):
        last = state = None
        for c, b, d in rows:
            last, state = c, hashlib.sha256((state if c == last else ROOT) + d).digest()[:16]
            yield c, b + 1, state

    def chain(rows):
        key = start = running = before = None
        for c, b, depth, d, n, total in rows:
            if (c, b) != key:
                key, start, running = (c, b), ROOT, hashlib.sha256()
                before = start
            if depth < 0:  # the state that the blocks before left
                start = before = d
                continue
            running.update(d)
            here = hashlib.sha256(start + running.digest()).digest()[:16]
            yield c, depth, here, before, n, depth == total
            before = here

    full = placed.filter(f"block < (total - 1) div {p.block}").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")
    parts = map_rows(full.select("conv_id", "block", "depth", "digest"), lambda: contents, "conv_id long, block long, digest binary")
    parts = map_rows(parts.repartition("conv_id").sortWithinPartitions("conv_id", "block"), lambda: states, "conv_id long, block long, digest binary")
    starts = parts.select("conv_id", "block", F.lit(-1).cast("long").alias("depth"), "digest", F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("total"))
    rows = placed.select(*starts.columns).unionByName(starts).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")
    return map_rows(rows, lambda: chain, "conv_id long, depth long, digest binary, parent binary, bytes long, last boolean")


def endings(ends: DataFrame, p: Params) -> DataFrame:
    """(digest, ends_sha256) of ends(digest, conv_id): the digest of the ids in order, comma-joined. A range sort splits
    an ending of any size; its ids travel in chunks and are digested in order, without being held."""

    def chunks(rows):
        key, held = None, []
        for d, c in rows:
            if d != key or len(held) >= p.chunk:
                if held:
                    yield key, held[0], ",".join(map(str, held)).encode()
                key, held = d, []
            held.append(c)
        if held:
            yield key, held[0], ",".join(map(str, held)).encode()

    def join(rows):
        key = running = None
        for d, _, ids in rows:
            if d != key:
                if key:
                    yield key, running.hexdigest()
                key, running = d, hashlib.sha256(ids)
            else:
                running.update(b"," + ids)
        if key:
            yield key, running.hexdigest()

    ranged = ends.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    pieces = map_rows(ranged, lambda: chunks, "digest binary, first long, ids binary")
    return map_rows(pieces.repartition("digest").sortWithinPartitions("digest", "first"), lambda: join, "digest binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", params: Params = Params()) -> DataFrame:
    """A row for each node: digest, conv_id (smallest member), depth, parent (its digest), parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    Null roles and texts are empty. Rows whose conversation is null or no number belong to none. Repeated rows are turns
    like any other; turns with one number stand by role, then text. An empty table gives no node, not even the root.
    Other columns are not read. Two sequences get one digest by chance once in about 10^19 pairs of 10^10 nodes."""
    p = params
    turns = numbered_turns(conversations, conv_id, turn, role, text)
    convs, sequence = rebuilt(turns, p)
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"), (F.col("total") == 0).alias("last"))
    paths = materialize(prefixes(sequence, p).unionByName(root), "prefixes")
    discard(turns, convs)
    nodes = paths.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("bytes").alias("bytes"))
    nodes = materialize(nodes, "nodes")
    kids = materialize(nodes.filter("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children")), "children")

    # A node's own saving and whether it is a leaf, on the row of its smallest member; then summed from below.
    worth = nodes.join(kids, "digest", "left").select("conv_id", "depth", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("digest"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.col("n_children").isNull().cast("long").alias("leaf"))
    zero = F.lit(0).cast("long")
    rows = worth.unionByName(paths.select("conv_id", "depth", F.lit(1).alias("kind"), "digest", zero.alias("saved"), zero.alias("leaf"))).withColumn("block", F.expr(f"depth div {p.block}"))
    below = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("saved", F.sum("saved").over(below)).withColumn("leaf", F.sum("leaf").over(below)).filter("kind = 1")
    # Of long conversations, what the blocks below add.
    long = paths.filter(f"last and depth >= {p.block}").select("conv_id")
    blocks = worth.join(long, "conv_id", "left_semi").groupBy("conv_id", F.expr(f"depth div {p.block}").alias("block")).agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    ladder = long.join(paths.filter("last").select("conv_id", "depth"), "conv_id").select("conv_id", F.explode(F.sequence(zero, F.expr(f"depth div {p.block}"))).alias("block"))
    ladder = ladder.join(blocks, ["conv_id", "block"], "left").na.fill(0)
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    more = ladder.select("conv_id", "block", F.sum("s").over(later).alias("s"), F.sum("l").over(later).alias("l")).filter("l > 0 or s > 0")
    subtree = summed.join(more, ["conv_id", "block"], "left").select("digest", (F.col("saved") + F.coalesce("s", zero)).alias("saved_tokens"), (F.col("leaf") + F.coalesce("l", zero)).alias("n_leaves"))
    subtree = subtree.groupBy("digest").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))

    # Parents' names: those of parents with very many children by broadcast, the others by a join.
    total = kids.agg(F.sum("n_children")).first()[0] or 0
    names = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hot = kids.filter(F.col("n_children") * p.hot > total).select(F.col("digest").alias("parent"))  # fewer than p.hot rows
    children = nodes.filter("parent is not null").select("digest", "parent")
    near = children.join(F.broadcast(names.join(F.broadcast(hot), "parent", "left_semi")), "parent")
    far = children.join(F.broadcast(hot), "parent", "left_anti").join(names, "parent")

    # All facts of a node meet in one grouping.
    facts = ["conv_id", "depth", "parent", "n_convs", "parent_conv_id", "n_children", "saved_tokens", "n_leaves", "ends_sha256"]
    types = {"parent": "binary", "ends_sha256": "string"}
    fill = lambda df: df.select("digest", *[F.col(c) if c in df.columns else F.lit(None).cast(types.get(c, "long")).alias(c) for c in facts])
    out = fill(nodes.select("digest", "conv_id", "depth", "parent", "n_convs"))
    for part in (near.select("digest", "parent_conv_id"), far.select("digest", "parent_conv_id"), kids, subtree, endings(paths.filter("last"), p)):
        out = out.unionByName(fill(part))
    out = out.groupBy("digest").agg(*[F.max(c).alias(c) for c in facts])
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("digest", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("digest", "parent")


#: Sequences as lists; subtrees by comparing every pair of nodes. crc32 is spelt out, byte by byte and bit by bit.
OP11_SQL = r"""
with t as (
  select conv_id::bigint conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) pos, coalesce(role, '') r, coalesce(text, '') x
  from conversations where conv_id is not null),
l as (select conv_id, list(struct_pack(r := r, x := x) order by pos) s from t group by 1),
h as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: xor(v >> 1, case when v & 1 = 1 then 3988292384::bigint else 0::bigint end))), 4294967295::bigint) % 9 h from l),
b as (select h.conv_id, list_concat(coalesce(base.s[1:h.h], []), h.s[h.h + 1:]) s from h left join l base on base.conv_id = h.conv_id - h.conv_id % 5),
p as (select conv_id, len(s) n, unnest(range(0, len(s) + 1)) d, s from b),
nodes as materialized (
  select d, s[1:d] k, min(conv_id) conv_id, count(*) n_convs, case when d = 0 then 0 else strlen(any_value(s[d].x)) end w,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '')) ends_sha256
  from p group by 1, 2),
kids as materialized (select d - 1 d, k[1:d - 1] k, count(*) n_children from nodes where d > 0 group by 1, 2),
full_nodes as materialized (select nodes.*, coalesce(n_children, 0) n_children from nodes left join kids using (d, k)),
sub as (select a.d, a.conv_id, count(*) filter (where b.n_children = 0) n_leaves, sum((b.n_convs - 1) * b.w) saved from full_nodes a join full_nodes b on b.d >= a.d and b.k[1:a.d] = a.k group by 1, 2)
select n.conv_id, n.d::bigint depth, q.conv_id parent_conv_id, n.n_convs::bigint n_convs, n.n_children::bigint n_children, n_leaves::bigint n_leaves, saved::bigint saved_tokens, n.ends_sha256
from full_nodes n join sub on sub.d = n.d and sub.conv_id = n.conv_id left join nodes q on q.d = n.d - 1 and q.k = n.k[1:n.d - 1]
"""
