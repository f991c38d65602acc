"""SimHash fingerprints and components against all pairs, the thresholds' promise, and the awkward rows."""

import random
import re

import numpy as np
import pytest
import xxhash

from canopyflow.llm import registry, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, k=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def expected(rows):
    """By row number, as doc_ids repeat: fingerprint and component."""
    fp = [plain_fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 2 or rows[i][0] is not None and rows[i][0] == rows[j][0]]
    of = plain_components(range(len(rows)), near)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[of[i]] = min(d, least.get(of[i], d))
    return sorted(((d, f"{fp[i]:016x}", least.get(of[i])) for i, (d, _) in enumerate(rows)), key=str)


def result(frame):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in frame.collect()), key=str)


def texts(seed, n=220):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(200)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 60, 150]))]
        if rows and r.random() < 0.6:
            words = r.choice(rows)[1].split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rows = texts(seed)
    rows += [(300, None), (301, ""), (302, "\n \t"), (None, "no id"), (None, rows[3][1]), (304, "One TWO"), (305, "one two"), (5, rows[40][1]), (5, rows[77][1]), (306, "é 😀  x\x0by"), (307, "word " * 70000), (7, rows[7][1]), (7, rows[7][1])]
    docs = spark.createDataFrame([(t, d, 1, "x", 2) for d, t in rows], "text string, doc_id long, fp long, key string, component_id int").repartition(3)
    assert result(simhash.near_duplicates(docs)) == expected(rows)
    # buckets that must be split, and other numbers of partitions
    assert result(simhash.near_duplicates(docs, cap=4, partitions=2 + seed)) == expected(rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("m", [2, 3, 4])
def test_links_of_crowded_fingerprints(spark, m):
    """Fingerprints close to few centres, so that buckets are large and thresholds unequal."""
    r = random.Random(m)
    centres = [r.getrandbits(64) for _ in range(3)]
    seen = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 1, 1, 2, 3, 5]))) for c in centres for _ in range(150)} | {r.getrandbits(64) & 0xFFFF for _ in range(150)})
    signed = [x - (1 << 64) if x >> 63 else x for x in seen]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    for cap in (4096, 30):
        got = [(r["a"], r["b"]) for r in simhash.near_links(nodes, cap=cap, partitions=m).collect()]
        assert all(a != b for a, b in got)
        want = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
        assert plain_components(signed, got) == plain_components(signed, want)
        assert len(got) <= 8 * m * len(signed) and (len(got) < len(want) or cap == 30)


def test_thresholds_are_optimal_and_sum_up(spark):
    r = np.random.default_rng(4)
    fp = np.concatenate([r.integers(0, 2**64, 300, dtype=np.uint64), r.integers(0, 2**20, 300, dtype=np.uint64)])
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    for m in (2, 3, 4):
        groups = simhash.group_bits(simhash.bit_counts(nodes), len(fp), m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        by = simhash.Partitioning(groups, 2, len(fp)).count(nodes)
        limits, cost = by.allocate(fp), by.costs(fp)
        assert (limits.sum(1) == 3 - m).all() and limits.min() >= -1
        ways = [w for w in np.ndindex(*[4] * m) if sum(w) == 3]
        for i in range(0, len(fp), 37):
            assert np.isclose(sum(cost[i, p, limits[i, p] + 1] for p in range(m)), min(sum(cost[i, p, u] for p, u in enumerate(w)) for w in ways))
        part = by.parts[0][0]
        seen = simhash._value(fp, part)
        d = np.bitwise_count((seen[0] ^ seen).astype(np.uint64))
        assert np.allclose(by.near[0][0][seen[0]] * len(fp), [(d == t).sum() for t in range(3)])


def test_registered_query(spark):
    got = registry.queries()["op11_simhash"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len({r["doc_id"] for r in got}) and all(r["component_id"] <= r["doc_id"] for r in got)
