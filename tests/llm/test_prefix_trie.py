"""The conversation trie against a tree built turn by turn in memory."""

import hashlib
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from lexmill.llm import prefix_trie as trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])
        built[c] = tuple(base[:h] + s[h:])
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out = []
    sums = {}
    for k in sorted(members, key=len, reverse=True):
        own_saving = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        below = [sums[x] for x in kids.get(k, [])]
        sums[k] = (sum(x for x, _ in below) or (0 if below else 1), own_saving + sum(y for _, y in below))
        ends = ",".join(map(str, sorted(c for c in members[k] if len(built[c]) == len(k))))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids.get(k, [])), *sums[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("digest", F.lit("x")).withColumn("depth", F.lit(7)).withColumn("extra", F.create_map(F.lit("a"), F.lit(1))).repartition(5)


def random_rows(seed, n, length):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([0, 1, 2, 3, rng.randrange(length)])):
            rows.append((c - 7, t if rng.random() < 0.9 else rng.choice([None, 0]), rng.choice(["user", "assistant", None]), rng.choice(["", None, "hé", "a b c", "x" * rng.randrange(4)])))
    return rows + [(None, 1, "user", "no conversation"), *rows[:3]]


def check(spark, rows, **params):
    got = trie.prefix_trie(frame(spark, rows), params=trie.Params(**params))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == brute(rows)


def test_against_brute_force(spark):
    check(spark, random_rows(1, 60, 14))


def test_blocks_hot_parents_and_chunks(spark):
    """Tiny blocks, chunks and a low bound for hot parents give the same nodes."""
    for seed in (2, 3):
        check(spark, random_rows(seed, 40, 30), block=3, hot=10, chunk=2)


def test_one_conversation_holds_most_turns(spark):
    rows = [(10, t, "user", f"t{t % 50}") for t in range(3000)] + [(c, t, "user", "same") for c in range(300) for t in range(2)]
    check(spark, rows, block=256)


def test_turns_of_one_number_and_copies(spark):
    check(spark, [(0, 1, "b", "x"), (0, 1, "a", "y"), (0, None, "z", "q"), (0, 1, "a", "x"), (1, 0, None, None), (1, 0, "", ""), (5, 3, "u", "v"), (6, 3, "u", "v"), (7, 3, "u", "v")])


def test_empty_and_turnless(spark):
    assert trie.prefix_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
    c = next(i for i in range(1, 1000) if i % 5 and zlib.crc32(str(i).encode()) % 9 > 2)  # no base, all turns cut
    check(spark, [(c, 0, "user", "x")])


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    want = con.execute(trie.OP11_SQL)
    names = [d[0] for d in want.description]
    got = trie.op11_prefix_trie(spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
