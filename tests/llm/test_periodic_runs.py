"""Periodic runs against direct comparison of every stretch, and the indexes against plain loops."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from canopyflow.llm import periodic_runs as P
from canopyflow.llm import registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=24, exponent=3):
    """Maximal stretches of every period; of equal stretches the smallest period."""
    best = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, exponent * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def periodic_text(r):
    words = []
    while len(words) < r.choice([0, 5, 60, 200, 500]):
        unit = [r.choice("aAbcdé") for _ in range(r.choice([1, 1, 2, 3, 7, 8, 9, 20]))]
        words += (unit * r.randint(1, 40))[: r.randint(1, 90)]
    return r.choice([" ", "\n", " \t "]).join(words)


@pytest.mark.parametrize("seed", range(2))
def test_against_every_stretch(spark, seed):
    r = random.Random(seed)
    rows = [(i, periodic_text(r)) for i in range(250)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (None, "x " * 30), (None, None), (5, rows[5][1]), (904, "A a " * 40), (905, "w " * 23), (906, "w " * 24), (907, "p q r " * 8), (908, "a b c d e f g h i " * 3), (909, "a b c d e f g h i " * 2)]
    docs = spark.createDataFrame([(t, d, [1], 5, "x") for d, t in rows], "text string, doc_id long, runs array<int>, start long, words string").repartition(5)
    got = P.digests(P.find_runs(P.looped(docs)))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_row(*x) for x in rows), key=str)


def test_other_bounds(spark):
    r = random.Random(9)
    rows = [(i, periodic_text(r)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least, exponent in ((2, 2), (10, 4), (7, 3)):
        got = {x["doc_id"]: [tuple(y) for y in x["runs"]] for x in P.find_runs(docs, least, exponent).collect()}
        assert got == {i: plain_runs(WORD.findall(t), least, exponent) for i, t in rows}


def test_empty(spark):
    assert P.digests(P.find_runs(P.looped(spark.createDataFrame([], "doc_id long, text string")))).collect() == []


def test_long_loops(spark):
    unit = [f"w{i}" for i in range(7000)]
    rows = [(1, "same " * 200_000), (2, " ".join(unit * 3)), (3, " ".join(unit + unit[:-1]))]
    got = {x["doc_id"]: ([tuple(y) for y in x["runs"]], x["collapsed"]) for x in P.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ([(0, 200_000, 1)], "same")
    assert got[2] == ([(0, 21_000, 7000)], " ".join(unit))
    assert got[3] == ([], rows[2][1])


def test_extensions_against_plain_loops():
    r = np.random.default_rng(3)
    for words in (r.integers(0, 3, 200), np.zeros(90, int), np.arange(50), np.tile(r.integers(0, 5, 13), 12), np.zeros(1, int)):
        e, n = P.Extensions(words.astype(np.int32)), len(words)
        i, j = np.meshgrid(np.arange(n + 1), np.arange(n + 1))
        i, j = i[i != j], j[i != j]
        want = []
        for a, b in zip(i, j):
            k = 0
            while max(a, b) + k < n and words[a + k] == words[b + k]:
                k += 1
            want.append(k)
        assert (e.shared(i, j) == want).all()


def test_range_minima():
    r = np.random.default_rng(1)
    for n in (1, 2, 15, 16, 17, 100, 1000):
        v = r.integers(0, 1000, n).astype(np.int32)
        lo, hi = np.sort(r.integers(0, n, (2, 500)), axis=0)
        assert (P.RangeMin(v).least(lo, hi) == [v[a : b + 1].min() for a, b in zip(lo, hi)]).all()


def test_registered_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted((plain_row(x["doc_id"], x["text"]) for x in docs.collect()), key=str)
    got = registry.queries()["op13_periodic_runs"](spark, "/root/testdata/sf0.001").select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == want and any(x[1] for x in want)
