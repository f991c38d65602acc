"""Each operator against brute force, an exact round trip, or held-out accuracy, with the awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyflow.llm import byte_bpe, html_extract, interpolated_lm, language_id, mixing, near_dedup, prefix_forest, quality, quality_rules, sharding
from canopyflow.llm.folds import fold
from canopyflow.llm.html_blocks import blocks
from canopyflow.llm.html_training import labelled_pages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid long, score double, label int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=0, n=120):
    """Documents with copies, near copies, empties, nulls, junk, a long one, and columns with clashing names."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([3, 12, 40, 90]))]
        if rows and r.random() < 0.4:
            words = (r.choice(rows)[1] or "x").split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 2, 6])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows += [(n, ""), (n + 1, None), (n + 2, " \n\t"), (n + 3, "One two"), (n + 4, "one TWO"), (n + 5, "word " * 20000), (n + 6, "é ü 😀\n\n# # #"), (n + 6, "é ü 😀\n\n# # #"), (None, "no id at all here")]
    return [(d, t, ["en", "de", None][k % 3], "hot" if k % 3 else f"s{k % 5}", 1, 7, 0.5, 1) for k, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text, k):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_all_pairs(docs, k):
    rows = {r["doc_id"]: shingle_set(r["text"], k) for r in docs.collect() if r["doc_id"] is not None}
    parent = {d: d for d in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            i = len(rows[a] & rows[b])
            if a < b and i and 100 * i >= 80 * len(rows[a] | rows[b]) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    got = near_dedup.near_duplicates(docs, k=k).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(rows[r["doc_id"]]), root(r["doc_id"]), root(r["doc_id"]) == r["doc_id"])


def test_near_duplicates_of_a_hot_group(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(260):  # near copies of one text, many of them further from each other than the threshold
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingle_set(t, 4) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            i = len(sets[a] & sets[b])
            if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(d, k=4).collect()} == {i: root(i) for i in sets}


def test_near_duplicates_follow_a_chain_of_revisions(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # each version is 0.8-like to its neighbours only
        rows.append((i, " ".join(words)))
        at = r.randrange(20, 100)
        words = words[:at] + [f"v{i}a", f"v{i}b", f"v{i}c"] + words[at + 3 :]
    rows += [(1000 + i, None) for i in range(3)] + [(None, "alone")]
    got = {x["doc_id"]: x for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert {got[i]["component_id"] for i in range(150)} == {0} and got[0]["kept"] and not got[149]["kept"]
    assert all(got[1000 + i]["component_id"] == 1000 + i and got[1000 + i]["n_shingles"] == 0 for i in range(3))
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_near_duplicates_of_nothing(spark, empty):
    assert near_dedup.near_duplicates(empty, k=4).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, None), (2, "")], "doc_id long, text string")
    assert sorted((x["doc_id"], x["component_id"], x["kept"]) for x in near_dedup.near_duplicates(nulls, k=4).collect()) == [(1, 1, True), (2, 2, True), (2, 2, True)]


def test_odd_sketches_estimate():
    rng = np.random.default_rng(1)
    for share in (0.6, 0.8, 0.95):
        a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        b = a.copy()
        n = int(2000 * (1 - share) / (1 + share))
        b[:n] = rng.integers(0, 2**63, n, dtype=np.uint64)
        sets = np.concatenate([np.sort(a), np.sort(b)])
        s = near_dedup.odd_sketch(near_dedup.minhash(sets, np.array([0, 2000, 4000]), 288))
        bits = int(np.bitwise_count(s[0] ^ s[1]).sum())
        assert abs(bits - near_dedup.differing_bits(share, 288)) < 30


def test_mixing_plan():
    tokens = {"a": 8000, "b": 1000, "c": 500, None: 500, "none": 0}
    p = mixing.plan(tokens, entropy_share=0.9, max_repeats=100)
    assert p.entropy == pytest.approx(0.9 * math.log(4), abs=1e-6) and sum(p.weights.values()) == pytest.approx(1)
    q = mixing.plan(tokens, entropy_share=1.0, max_repeats=4)
    assert mixing.most_repeats({s: n / 10000 for s, n in tokens.items() if n}, q.weights) == pytest.approx(4, rel=1e-6)
    assert mixing.plan({"a": 5, "b": 5}).alpha == 1.0
    assert mixing.plan({}).budgets == {}


def test_mixing_realises_the_weights(spark, docs, empty):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(5, 15)), "big" if i < 800 else "mid" if i < 1000 else "small") for i in range(1100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens = collections.Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split())
    p = mixing.plan(tokens, 0.97, 4.0)
    out = mixing.mix(d).collect()
    used, first = collections.Counter(), collections.defaultdict(set)
    for x in out:
        used[x["source"]] += x["tokens"]
        first[x["doc_id"]].add(x["epoch"])
        assert 0 <= x["position"] < 1 and x["block"] == int(x["position"] * 64)
    assert all(0 in e and e == set(range(len(e))) for e in first.values()) and len(first) == 1100
    for s in tokens:
        assert abs(used[s] - p.budgets[s]) <= 16
    per_block = collections.Counter((x["block"], x["source"]) for x in out)
    assert all(per_block[b, "big"] > 2 for b in range(64))
    awkward = mixing.mix(docs)
    assert set(docs.columns) <= set(awkward.columns)
    assert {x["doc_id"] for x in awkward.collect()} == {x["doc_id"] for x in docs.collect()}
    assert mixing.mix(empty).count() == 0


def brute_lm(rows):
    tokens = {d: WORD.findall(lower(t)) + [None] for d, t in rows}
    train = {d: zlib.crc32(str(d).encode()) % 5 != 1 for d in tokens}
    one, two, context = collections.Counter(), collections.Counter(), collections.Counter()
    for d, t in tokens.items():
        if train[d]:
            for u, w in zip(["<s>", *t[:-1]], t):
                one[w] += 1
                two[u, w] += 1
                context[u] += 1
    return tokens, train, one, two, context


def test_interpolated_lm_against_counts(spark):
    rows = [(r[0], r[1]) for r in corpus(2, 150)[:150]]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    tokens, train, one, two, context = brute_lm(rows)
    n, v = sum(one.values()), len(one)
    got = {r["doc_id"]: r for r in interpolated_lm.score(d, fold("doc_id", 5) != 1, chunk_bytes=4000).collect()}
    better = 0
    for i, t in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(one[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        # the mixture lies between its least and its greatest component
        low = sum(math.log10(min((one[w] + 0.5) / (n + 0.5 * (v + 1)), 1)) for w in t) - 8 * len(t)
        assert low < r["score"] < 0
        better += r["score"] > r["base_score"]
    assert better > 0.7 * len(rows)


def test_lm_estimates_and_em():
    cells = np.array([[3, 2.0, 0.0, 900.0], [3, -np.inf, 0.0, 100.0]])
    w = interpolated_lm.fit_weights(cells)[3]
    assert w.sum() == pytest.approx(1) and 0.7 < w[0] < 0.95
    assert interpolated_lm.fit_weights(np.zeros((0, 4))).sum(1) == pytest.approx(np.ones(interpolated_lm.BUCKETS))


def test_lm_awkward_rows(docs, empty):
    out = interpolated_lm.score(docs, fold("doc_id", 5) != 1).collect()
    assert len(out) == docs.count() and all(math.isfinite(r["score"]) for r in out)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (120, 121, 122)} == {1}
    assert interpolated_lm.score(empty, F.lit(True)).count() == 0
    assert {r["score"] for r in interpolated_lm.score(docs, F.lit(False)).collect()} == {0.0}


def test_prefix_forest_recall_and_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 32)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[700:760] = x[700]
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    rows += [(1501, None), (1502, [0.0] * 32), (1503, [float("nan")] * 32), (1504, [None] * 32), (1505, []), (None, [1.0] * 32), (1520, [1.0, 2.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in prefix_forest.nearest(d, k=20, every=20, shard_rows=600, block_rows=40).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        want = [int(i) for i in np.lexsort((np.arange(1500), -np.round(s, 9))) if i != q][:20]
        found = sorted(got[q])
        assert [k for k, _, _ in found] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        assert all(s[v] == pytest.approx(z) for _, v, z in found)
        hit += len(set(want) & {v for _, v, _ in found})
    assert hit / (75 * 20) >= 0.9 and set(got) == set(range(0, 1500, 20))


def test_forest_goes_on_past_a_few_copies(spark):
    r = np.random.default_rng(8)
    for n, copies in ((15, 1), (500, 3), (500, 19), (2000, 9)):
        x = r.standard_normal((n, 16))
        x /= np.linalg.norm(x, axis=1)[:, None]
        x[1:copies] = x[0]
        d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = sorted((y["rank"], y["vec_id"]) for y in prefix_forest.nearest(d).where("query_id = 0").collect())
        want = [int(i) for i in np.lexsort((np.arange(n), -np.round(x @ x[0], 9))) if i != 0][:20]
        assert [k for k, _ in got] == list(range(1, len(want) + 1))
        found = [v for _, v in got]
        assert set(range(1, copies)) <= set(found) and len(set(found) & set(want)) >= 0.9 * len(want)


def test_forest_of_huge_and_tiny_vectors(spark):
    r = np.random.default_rng(3)
    for scale in (1e20, 1e-30, 1e150):
        x = r.standard_normal((200, 8)) * scale
        d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = prefix_forest.nearest(d, k=20).collect()
        assert len(got) == 10 * 20
        want = {(q, i) for q in range(0, 200, 20) for i in sorted((i for i in range(200) if i != q), key=lambda i: (-(x[i] * x[q]).sum(), i))[:20]}
        assert len(want & {(g["query_id"], g["vec_id"]) for g in got}) >= 0.9 * len(want)
        assert all(g["score"] == (x[g["vec_id"]] * x[g["query_id"]]).sum() for g in got)


def test_forest_of_nothing(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert prefix_forest.nearest(d, k=20).collect() == []
    assert prefix_forest.nearest(spark.createDataFrame([(i, [1.0 + i, 2.0]) for i in range(1, 19)], d.schema), k=20).collect() == []


def test_language_id(spark, docs, empty):
    r = random.Random(1)
    alphabets = {"xx": "aeioubdg", "yy": "öäüßstrn", "zz": "жшюяклмн"}
    rows = [(i, " ".join("".join(r.choice(alphabets[k]) for _ in range(r.randint(2, 7))) for _ in range(30)), k) for i, k in enumerate(r.choices(list(alphabets), k=300))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(d.where("doc_id < 200"))
    out = {x["doc_id"]: x for x in language_id.score(d, model).collect()}
    assert all(out[i]["lang_pred"] == k and 0 <= out[i]["score"] <= 1 for i, _, k in rows)
    odd = {x["doc_id"]: x["lang_pred"] for x in language_id.score(docs, model).collect()}
    assert odd[120] == odd[121] == odd[122] == "und" and len(odd) == docs.select("doc_id").distinct().count()
    none = language_id.train(empty)
    assert {x["lang_pred"] for x in language_id.score(docs, none).collect()} == {"und"}
    assert language_id.score(empty, model).count() == 0


def test_rules_against_plain_python(docs, empty):
    def brute(text):
        t = text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    out = quality_rules.cascade(docs)
    for r in out.select("text", *quality_rules.MEASURES, "kept", "rejected_by").collect():
        assert tuple(r)[1:6] == brute(r["text"])
        assert r["kept"] == (r["rejected_by"] is None)
    assert quality_rules.cascade(empty).count() == 0
    rules = quality_rules.default_rules()
    one, other = ({(r["doc_id"], r["kept"]) for r in quality_rules.measures(docs).withColumn("kept", quality_rules.first_rejection(x).isNull()).collect()} for x in (rules, rules[::-1]))
    assert one == other
    slow, fast = quality_rules.RuleCost(rules[0], 1.0, 10), quality_rules.RuleCost(rules[1], 0.1, 10)
    assert quality_rules.order([slow, fast]) == [rules[1], rules[0]]


def test_html_field(spark):
    model = html_extract.trained()
    pages = labelled_pages(150, seed=77)
    hit = total = 0
    for page, labels in pages:
        found = blocks(page)
        if len(found) == len(labels):
            states = model.decode([b.features for b in found])
            hit += sum(int(a) == b for a, b in zip(states, labels))
            total += len(labels)
    assert total > 500 and hit / total > 0.97
    page = "<html><head><title>T</title><script>var a='</p>'</script></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; b</h1><p><b>First  one.<br><p>Second &eacute;\n two.</article><div class=comments><p>Nice, I agree with all of it.</p></div><footer>&copy; x</footer>"
    d = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", page)], "page_id long, url string, html string")
    out = html_extract.extract(d, model).collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in out] == [(1, "A & b First one. Second é two.", 30), (2, "", 0), (3, "", 0), (None, "A & b First one. Second é two.", 30)]


def test_closed_svg_and_custom_elements_swallow_nothing():
    from canopyflow.llm.html_blocks import blocks

    article = "<article><p>The text of the page.</p></article>"
    for before in ("<svg/>", "<svg class='i' />", '<svg aria-label="a > b" width="1"/>', "<title-bar>", "<object-card x=1>", "<svg-icon></svg-icon>", "<TEMPLATE-x/>"):
        for after in ("", "<svg><text>no</text></svg>", "<title>no</title>"):
            assert [b.text for b in blocks(before + article + after)] == ["The text of the page."]
    for hidden in ("<svg viewBox='0'><path/><text>no</text></svg>", "<script src=a/>no</script>", "<title\n>no</title >", "<object>no</object>"):
        assert [b.text for b in blocks(hidden + article)] == ["The text of the page."]
    assert [b.text for b in blocks("<p>a <svg/>b</p>")] == ["a b"]


def test_field_decodes_the_best_path():
    import itertools

    f = html_extract.Field({"x": 1.3, "y": -0.7}, 0.2, -0.4, ((0.5, -0.6), (-0.3, 0.8)))
    r = random.Random(2)
    for _ in range(30):
        seq = [r.sample(["x", "y", "z"], r.randint(0, 3)) for _ in range(6)]

        def value(path, seq=seq):
            s = sum(f.weights.get(q, 0) * p for p, fs in zip(path, seq) for q in fs) + f.start * path[0] + f.end * path[-1]
            return s + sum(f.step[a][b] for a, b in zip(path, path[1:]))

        assert value([int(q) for q in f.decode(seq)]) == pytest.approx(max(value(p) for p in itertools.product((0, 1), repeat=6)))


def test_sharding(spark, docs, empty):
    r = random.Random(9)
    d = spark.createDataFrame([(i, "x" * r.randint(1, 300)) for i in range(4000)], "doc_id long, text string")
    out = sharding.shard(d).collect()
    load, slots = collections.Counter(), collections.defaultdict(list)
    for x in out:
        load[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
        assert x["law"] == "bytes" and x["grown_shard"] is None
    mean = sum(load.values()) / 16
    assert max(load.values()) <= 1.002 * mean + 302 and min(load.values()) >= 0.97 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(x["doc_id"] for x in out) == list(range(4000))
    again = {x["doc_id"]: x["shard"] for x in sharding.shard(d.orderBy(F.rand(3))).collect()}
    assert again == {x["doc_id"]: x["shard"] for x in out}
    odd = sharding.shard(docs).collect()
    assert len(odd) == docs.count() and all(x["size"] == 1 and x["text_crc32"] == 0 for x in odd if x["doc_id"] in (120, 121))
    assert sharding.shard(empty).count() == 0
    # limited movement: a shard more moves few rows between the old ones
    grown = {x["doc_id"]: x["shard"] for x in sharding.shard(d, shards=17, slack=0.25).collect()}
    before = {x["doc_id"]: x["shard"] for x in sharding.shard(d, slack=0.25).collect()}
    assert sum(grown[i] != before[i] and grown[i] != 16 for i in grown) < 0.15 * len(grown)


def test_hash_ring_splits_a_hot_key(spark):
    r = random.Random(6)
    rows = [(i, "a" * r.randint(1, 300)) for i in range(4000)]
    hot = [(None, f"text {i} " * 8) for i in range(900)] + [(None, "the same text again")] * 4000 + [(7, "b" * 100)] * 900
    d = spark.createDataFrame(rows + hot, "doc_id long, text string")
    out = sharding.shard(d).collect()
    load, slots = collections.Counter(), collections.defaultdict(list)
    for x in out:
        load[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
    mean = sum(load.values()) / 16
    assert max(load.values()) <= (1.002 + 2 / sharding.HOT) * mean and len(load) == 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    same = lambda got: collections.Counter((x["doc_id"], x["size"], x["text_crc32"], x["shard"]) for x in got)
    assert collections.Counter(x["doc_id"] for x in out) == collections.Counter(i for i, _ in rows + hot)
    assert same(out) == same(sharding.shard(d.orderBy(F.rand(3)).repartition(7)).collect())


def test_ring_assignment_against_a_walk():
    points = sharding.ring(4, 8)
    rng = random.Random(4)
    loads = {(s, a): rng.randint(1, 9) for s in range(20) for a in range(32)}
    got = sharding.assign(loads, points, 4, 0.01)
    bound, used = 1.01 * sum(loads.values()) / 4, [0] * 4
    for s, a in sorted(loads):
        order = list(dict.fromkeys(points[(a + i) % 32][1] for i in range(32)))
        shard = next((x for x in order if used[x] + loads[s, a] <= bound), None)
        shard = min(order, key=lambda x: used[x]) if shard is None else shard
        used[shard] += loads[s, a]
        assert got[s, a] == shard


def test_quality_pu(spark, docs, empty):
    r = random.Random(6)

    def text(good):
        w = ["".join(r.choice("aeioulrst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 80))]
        return " ".join(w) + "." if good else " ".join(x.upper() + "!!" if good is None else x + "***" for x in w)

    kinds = [r.random() < 0.8 for _ in range(600)]
    rows = [(i, text(True if k else r.choice([None, False]))) for i, k in enumerate(kinds)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    positives = spark.createDataFrame([(i,) for i, k in enumerate(kinds) if k and i % 3 == 0], "doc_id long")
    model = quality.train(d, positives)
    assert 0.6 < model.prior <= 0.99
    out = {x["doc_id"]: x for x in quality.score(d, model).collect()}
    right = sum((out[i]["predicted"] == 1) == k for i, k in enumerate(kinds))
    assert right / 600 > 0.95
    assert quality.train(docs, empty) is None
    assert {x["score"] for x in quality.score(docs, None).collect()} == {0.5}
    assert len(quality.score(docs, model).collect()) == docs.count()
    assert quality.score(empty, model).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def test_bpe_against_the_library(spark, docs, empty, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = vocabulary
    ranks = byte_bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    extra = spark.createDataFrame([(900, "Hello  world,\n\n it's 12345 ünïcödé!! 😀😀 <|endoftext|>  x"), (901, "a" * 3000), (902, "\t \n")], "doc_id long, text string")
    d = docs.select("doc_id", "text").unionByName(extra)
    codec = byte_bpe.train_free_codec(d, path, pattern, cached_pieces=150)
    want = {}
    for r in d.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.setdefault(r["doc_id"], (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    for r in codec.digests(d).collect():
        assert tuple(r)[1:] == want[r["doc_id"]]
    encoded = codec.encode(d)
    for r in codec.decode(encoded).join(d, "doc_id").where("doc_id >= 900").collect():
        assert bytes(r["bytes"]) == (r["text"] or "").encode()
    assert codec.digests(empty).count() == 0


def test_fold_equals_merge(spark, vocabulary):
    ranks = byte_bpe.load_ranks(vocabulary[0])
    words = ["a", "the", " hello", "strawberries", "zzxqj", "é", "😀", "123", " ", "\n\n\n"]
    out = spark.createDataFrame([(w,) for w in words], "w string").select("w", byte_bpe.fold_merges(F.col("w").cast("binary"), byte_bpe.rank_literal(ranks)).alias("ids")).collect()
    assert {r["w"]: r["ids"] for r in out} == {w: byte_bpe.merge(w.encode(), ranks) for w in words}
