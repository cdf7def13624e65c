"""The prefix trie against a plain one built in Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tamarack.llm.prefix_trie import end_digests, lookup, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, c string, d string, k string, p1 string, len string"
COLUMNS = (
    "conv_id",
    "depth",
    "parent_conv_id",
    "n_convs",
    "n_children",
    "n_leaves",
    "saved_tokens",
    "ends_sha256",
)


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append(((turn is not None, turn or 0), tie, role, text))
    turns = {c: [(r, x) for _, _, r, x in sorted(own[c])] for c in own}
    members = defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        begin = c - int(c / 20) * 20 if c < 0 else c % 20
        full = turns.get(c - begin, [])[:h] + turns[c][h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].append((c, len(full) == d))
    out = []
    for node, own_members in members.items():
        below = [other for other in members if other[: len(node)] == node]
        kids = [other for other in below if len(other) == len(node) + 1]
        leaves = [u for u in below if not any(v[:-1] == u and v for v in members)]
        words = {u: len(re.findall(r"[^\x20\x09-\x0D]+", u[-1][1])) if u else 0 for u in below}
        ends = ",".join(str(c) for c in sorted(c for c, end in own_members if end))
        out.append(
            (
                min(c for c, _ in own_members),
                len(node),
                min(c for c, _ in members[node[:-1]]) if node else None,
                len(own_members),
                len(kids),
                len(leaves),
                sum((len(members[u]) - 1) * words[u] for u in below),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def some_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 64), -3, -21, -20, 10**12, 10**12 + 7]:
        shape = rng.choice([0, 1, 1, 2, 2, 3, 9])
        if c in (5, 25, 45):  # long copies that part late
            turns = [("user", f"long {i}") for i in range(12)] + ([("user", f"own {c}")] if c == 45 else [])
        else:
            turns = [(rng.choice(["user", "bot", None, ""]), rng.choice(["a b", "a  b\tc", "", None, "x"])) for _ in range(shape)]
        numbers = [rng.choice([None, 0, 1, 1, 5, i]) if c % 7 == 3 else i for i in range(len(turns))]
        rows += [(c, t, r, x) for t, (r, x) in zip(numbers, turns, strict=True)]
    return [*rows, (None, 0, "user", "nobody's"), *rows[:2]]


@pytest.mark.parametrize("seed,chunk,counters", [(1, 4096, 1 << 26), (2, 2, 64), (3, 3, 1 << 26)])
def test_trie_against_plain_one(spark, seed, chunk, counters):
    rows = some_rows(seed)
    found = prefix_trie(frame(spark, rows), chunk, counters)
    assert found.columns == list(COLUMNS)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_small_tables(spark):
    assert prefix_trie(frame(spark, [])).collect() == []
    for rows in ([(4, 0, "user", "hello you")], [(None, 1, None, None), (7, None, None, None)], [(40, 1, "a", "b")] * 3):
        found = prefix_trie(frame(spark, rows)).collect()
        assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_nested_chains_and_many_members(spark):
    """Every conversation a prefix of the one with the next smaller id: chains hang on chains, level by level."""
    rows = [(c, t, "user", f"turn {t} of all") for c in range(1000, 1040) for t in range(1040 - c + 3)]
    rows += [(c, 0, "user", "the same") for c in range(2000, 2300)]
    found = prefix_trie(frame(spark, rows), 5, 1 << 16).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows)


def test_hot_keys_are_joined_by_broadcast(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 5000, 1).otherwise(F.col("id")).alias("k"), "id")
    known = spark.createDataFrame([(1, "hot"), (5500, "cold")], "k long, v string")
    found = {(r.k, r.v) for r in lookup(rows, ["k"], known).distinct().collect() if r.v}
    assert found == {(1, "hot"), (5500, "cold")} and lookup(rows, ["k"], known).count() == 6000


def test_end_digests_over_many_pieces(spark):
    ids = [i * 3 for i in range(20000)]
    ends = spark.createDataFrame([(2, 5, 6, i) for i in ids] + [(2, 5, 7, 1)], "d long, p1 long, p2 long, c long")
    found = {r.p2: r.ends_sha256 for r in end_digests(ends.repartition(7)).collect()}
    assert found == {
        6: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        7: hashlib.sha256(b"1").hexdigest(),
    }
