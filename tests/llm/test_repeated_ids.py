"""Near duplicates where one doc_id stands on several texts: no link of its sets is lost."""

import random
import re

import pytest

from canopyflow.llm import near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain(rows, k, percent=80):
    """(doc_id, n_shingles, component_id, kept) of each row, by all pairs of rows."""
    sets = [shingles(t, k) for _, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((d, len(s), root(d), root(d) == d) for (d, _), s in zip(rows, sets))


@pytest.mark.parametrize("seed", range(4))
def test_a_set_of_two_documents_keeps_its_links(spark, seed):
    r = random.Random(seed)
    a, b = ([f"{x}{r.randrange(10**6)}" for _ in range(100)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (7, " ".join(b)), (9, " ".join(b[:-1] + ["other"])), (3, ""), (7, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert sorted(tuple(x)[:4] for x in got) == plain(rows, 4)
    assert {x["doc_id"]: x["component_id"] for x in got} == {1: 1, 3: 3, 7: 1, 9: 1}


@pytest.mark.parametrize("seed", range(2))
def test_many_repeated_ids(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        w = [r.choice(vocabulary) for _ in range(r.choice([3, 20, 60]))]
        if texts and r.random() < 0.6:
            w = r.choice(texts).split(" ")
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)] + [(r.randrange(70), r.choice(texts + ["", None])) for _ in range(12)] + [(50, texts[50])] * 30 + [(-4, texts[11]), (-4, texts[12])]
    docs = spark.createDataFrame([(t, d, 1, 2, "x") for d, t in rows], "text string, doc_id long, sid long, t int, s1 string").repartition(3)
    assert sorted(tuple(x)[:4] for x in near_dedup.near_duplicates(docs, k=4).collect()) == plain(rows, 4)
