"""Operators without SQL against plain-Python versions of what they compute."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyflow.llm import language_id, mixing, quality
from canopyflow.llm import textnp as T


def test_language_id_against_counted_bayes(spark):
    r = random.Random(11)
    alphabets = {"a": "aeioubdg ", "b": "aeöäüßst ", "c": "aeжшюякл "}
    rows = [(i, "".join(r.choice(alphabets[k]) for _ in range(r.randint(3, 60))), k if i % 9 else None) for i, k in enumerate(r.choices(list(alphabets), k=120))]
    rows += [(200, rows[0][1], "b"), (201, None, "a"), (202, "", "c"), (203, "12 3", None)]  # a text in two languages, empty ones
    buckets, alpha = 1 << 12, 0.5

    def grams(text):
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        chars, off = T.code_points(data, np.array([0, len(data)]))
        return [int(b) for k in language_id.ngram_buckets(chars, off, buckets) for b, ok in zip(*k) if ok] if len(data) else []

    seen, counts = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        if lang is not None:
            seen[lang] += 1
            counts[lang].update(grams(text))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in language_id.score(d, language_id.train(d, buckets=buckets, alpha=alpha)).collect()}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert got[i]["lang_pred"] == "und"
            continue
        total = {k: math.log(seen[k] / sum(seen.values())) + sum(math.log((counts[k][g] + alpha) / (sum(counts[k].values()) + alpha * buckets)) for g in grams(text)) for k in sorted(seen)}
        best = max(total, key=total.get)
        assert abs(got[i]["score"] - 1 / sum(math.exp(v - total[best]) for v in total.values())) < 1e-6
        assert got[i]["lang_pred"] == best or abs(total[got[i]["lang_pred"]] - total[best]) < 1e-9


@pytest.mark.parametrize("ranked", [50_000, 3])
def test_mix_against_sorting(spark, monkeypatch, ranked):
    monkeypatch.setattr(mixing, "MOST_RANKED", ranked)
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choices(["big", "mid", "small", None], [60, 20, 3, 2])[0]) for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens = collections.Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    budgets = mixing.plan(tokens, 0.97, 4.0).budgets
    epochs = spark.range(8).select(F.col("id").cast("int").alias("epoch"))
    order = {(x["doc_id"], x["epoch"]): x["h"] for x in d.crossJoin(epochs).select("doc_id", "epoch", F.xxhash64(F.lit(7), F.xxhash64("doc_id", "text"), "epoch").alias("h")).collect()}
    want = set()
    for s, total in tokens.items():
        own = [(i, len(t.split())) for i, t, o in rows if o == s]
        whole = int(budgets[s] / total + 1e-9)
        want |= {(i, e) for e in range(whole) for i, _ in own}
        left = int(round(budgets[s] - whole * total))
        for i, n in sorted(own, key=lambda x: (order[x[0], whole] % 2**64) >> 1):
            if left <= 0:
                break
            want.add((i, whole))
            left -= n
    got = {(x["doc_id"], x["epoch"]) for x in mixing.mix(d).select("doc_id", "epoch").collect()}
    assert got - {(i, e) for i, e in got if not rows[i][1]} == want - {(i, e) for i, e in want if not rows[i][1]}
    assert {i for i, _ in got} == set(range(900))


def test_mix_with_a_hot_key(spark):
    """A third of the ids are null, one row stands there a thousand times: blocks keep the weights."""
    r = random.Random(2)
    rows = [(None if i % 3 == 0 else i, " ".join(["w"] * r.randint(5, 15)) + f" {i}", "big" if r.random() < 0.8 else "small", i) for i in range(6000)]
    rows += [(77, "w w w w w w w w", "big", -1)] * 1000
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, take int").withColumns({"s": F.lit("x"), "h": F.lit(1), "my col": F.lit(2), "a:b": F.lit(3)})
    tokens = collections.Counter()
    for _, t, s, _ in rows:
        tokens[s] += len(t.split())
    weights = mixing.plan(tokens, 0.97, 4.0).weights
    out = mixing.mix(d, blocks=8)
    assert set(out.columns) == {*d.columns, *mixing.OUTPUT}
    out = out.collect()
    assert {(x["take"], x["text"]) for x in out} == {(x[3], x[1]) for x in rows} and all((x["s"], x["h"], x["my col"], x["a:b"]) == ("x", 1, 2, 3) for x in out)
    used = collections.Counter()
    for x in out:
        used[x["block"], x["source"]] += x["tokens"]
    for b in range(8):
        assert abs(used[b, "small"] / (used[b, "small"] + used[b, "big"]) - weights["small"]) < 0.02


def test_quality_fit_is_bounded_by_rows(spark):
    """One doc_id on thousands of rows brings no more positives to the driver than max_positive, and all rows count as unlabelled."""
    r = random.Random(1)
    good = lambda: " ".join("".join(r.choice("aeioulrst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 60))) + "."
    rows = [(7 if i < 1500 else i, good() if i % 4 else good().upper() + "!!***") for i in range(2400)] + [(7, "the same text. again")] * 600
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(1), "predicted": F.lit(2)})
    seen, plain = [], quality._descend
    quality._descend = lambda xp, xu, *a: seen.append((len(xp), len(xu), a[-1].sum())) or plain(xp, xu, *a)
    try:
        model = quality.train(d, spark.createDataFrame([(7,), (7,), (1501,), (None,)], "doc_id long"), max_positive=10)
    finally:
        quality._descend = plain
    assert {s[0] for s in seen} == {10} and all(s[1] <= max(1 << quality.CELL_BITS, quality.LEVELS << quality.LEVEL_BITS) for s in seen) and all(abs(s[2] - 1) < 1e-9 for s in seen)
    assert len(quality.score(d, model).collect()) == 3000


def test_quality_features_against_plain_counts():
    texts = ["Abc DEF, 12! ab ab ab\nline\nline\n", "", "é ö #*$ |", "word " * 50]
    for t, x in zip(texts, quality.feature_rows(*T.buffers(__import__("pyarrow").array(texts)))):
        data = t.encode()
        for k, group in enumerate(quality.GROUPS):
            assert abs(x[k] - sum(c in group.encode() for c in data) / max(1, len(data))) < 1e-6


def test_pu_fit_is_at_the_least_risk():
    r = np.random.default_rng(4)
    xp, xu = r.standard_normal((300, 5)) + 1.0, np.concatenate([r.standard_normal((200, 5)) + 1.0, r.standard_normal((400, 5)) - 1.0])
    prior, l2 = 0.34, 1e-2

    def risk(w, b):
        zp, zu = [float(x @ w + b) for x in xp], [float(x @ w + b) for x in xu]
        soft = lambda z: max(z, 0.0) + math.log1p(math.exp(-abs(z)))
        negative = sum(map(soft, zu)) / len(zu) - prior * sum(map(soft, zp)) / len(zp)
        return prior * sum(soft(-z) for z in zp) / len(zp) + max(0.0, negative) + l2 / 2 * float(w @ w)

    w, b = quality._descend(xp, xu, prior, 600, 0.05, l2)
    least = risk(w, b)
    for k in range(40):
        step = r.standard_normal(6) * (0.3 if k % 2 else 0.05)
        assert risk(w + step[:5], b + step[5]) >= least - 2e-3
    assert ((xu[200:] @ w + b) < 0).mean() > 0.9 and ((xp @ w + b) > 0).mean() > 0.9


def test_prior_of_separated_scores():
    positive, unlabelled = np.linspace(1, 2, 500), np.concatenate([np.linspace(1, 2, 300), np.linspace(-2, 0, 700)])
    assert 0.25 < quality.estimate_prior(positive, unlabelled) < 0.36
