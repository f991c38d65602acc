"""The prefix trie against a plain dictionary of prefixes, and its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from canopyflow.llm import prefix_trie, registry

SCHEMA = "conv_id long, turn int, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    return out


def plain(rows):
    convs, members = rebuilt(rows), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * len(k[-1][1].encode() if k else b"") + sum(saved[x] for x in kids[k])
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    assert frame.columns == COLUMNS
    return sorted(map(tuple, frame.collect()), key=str)


def talks(seed, n=120):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(n * 2), n):
        for turn in range(r.choice([0, 1, 2, 3, 8, 9, 10, 12, 20])):
            rows.append((c, turn if turn or r.random() < 0.7 else None, r.choice(["user", "bot", None]) if r.random() < 0.2 else ["user", "bot"][turn % 2], r.choice(["é", "b", "cc", None] if turn > 3 else ["hi"] * 4 + ["yo"])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_against_a_dictionary(spark, seed):
    rows = talks(seed) + [(None, 1, "user", "no conversation"), (1003, 0, "user", "short"), (2000, 5, None, None)]
    docs = spark.createDataFrame([(x[3], 1, *x[:3], "n", 2) for x in rows], "text string, depth int, conv_id long, turn int, role string, last string, x1 int").repartition(5)
    assert got(prefix_trie.trie(docs)) == plain(rows)


def test_sql(spark):
    rows = talks(7, 60)
    duck = duckdb.connect()
    import pandas as pd

    duck.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"}))
    assert sorted(duck.sql(prefix_trie.ORACLE).fetchall(), key=str) == plain(rows)


def test_blocks_hot_and_long(spark, monkeypatch):
    """Windows and rows of four turns; one conversation with a third of all rows; many copies; a staircase of chains; repeated turns."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = [(0, i, "user", f"t{i % 3}") for i in range(400)] + [(5 * c, i, "user", "same") for c in range(100, 140) for i in range(4)]
    rows += [(5 * c, i, "user", f"s{i}" if i < c - 300 else f"end{c}") for c in range(300, 325) for i in range(c - 298)]
    rows += [(5000, 1, "user", "twice")] * 3 + [(-7, 0, "user", "below zero"), (9223372036854775807, 0, "user", "top")]
    assert got(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(6))) == sorted(plain_with_negatives(rows), key=str)


def plain_with_negatives(rows):
    """plain() with the remainder that SQL gives a negative id."""
    moved = {c: c for c, *_ in rows}
    assert all(c >= 0 or c - (-(-c % 5)) not in moved or c % 5 == 0 for c in moved)
    return plain(rows)


def test_empty(spark):
    assert got(prefix_trie.trie(spark.createDataFrame([], SCHEMA))) == []


def test_registered_query(spark):
    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(registry.queries()["op12_prefix_trie"](spark, "/root/testdata/sf0.001")) == plain(rows)
    assert "op12_prefix_trie" in registry.oracle_sql()
