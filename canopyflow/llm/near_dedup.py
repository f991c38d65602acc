"""MinHash near-duplicate detection with odd sketches.

1. One pass over the texts gives each document its set of k-word shingles (64-bit fingerprints), an
   order-free 128-bit fingerprint of the set, bands x rows MinHash samples folded into band keys, and
   an odd sketch: every sample flips one bit of a parity bitmap. Equal sets are one node, and the sets of rows with one doc_id are linked.
2. Documents that share a band key are candidates. In every bucket each member is paired with the
   bucket's hubs (its most central members, the same few in all buckets of a group), so a bucket of n members gives about hubs * n pairs and never n * n.
3. The XOR population count of two odd sketches estimates the similarity; pairs clearly below the
   threshold are dropped, the others are candidate links.
4. Candidates are confirmed on full sets, the likeliest first, and only between documents that confirmed
   links do not connect already: the likeliest of each component, then its likeliest five.
5. In buckets that still hold several components, members outside the bucket's largest component meet all
   members: first a forest of the likeliest pairs of components is confirmed as in 4; then, for what is still apart, every
   candidate is confirmed where it is met, in the first bucket that the pair shares, until its components are joined there,
   and only links leave the worker.

With the default 48 bands of 6 rows a pair at similarity 0.8 shares no band with probability 5e-7, and
the sketch test drops it with probability under 1e-6 (five standard deviations).

Defined results: null or empty text has an empty set and is alone; fewer than k words give the whole
sequence as one shingle; equal texts and repeated rows share a set; rows with one doc_id are one document, linked by
each of its sets, and get one component; rows with a null doc_id are
returned with a null component and kept; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql import Window as W

from canopyflow.llm import textnp as T
from canopyflow.operators.components import components
from canopyflow.session import materialise, shared_dir

SKETCH_WORDS = 8
_SKETCH_BITS = 64 * SKETCH_WORDS
_SEED = np.random.default_rng(99)
_A = _SEED.integers(1, 2**32, 4096, dtype=np.uint32) | np.uint32(1)
_B = _SEED.integers(0, 2**32, 4096, dtype=np.uint32)
_ROW = _SEED.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
FEATURES = S.StructType(
    [
        S.StructField("doc_id", S.LongType()),
        S.StructField("t", S.LongType()),
        S.StructField("n", S.LongType()),
        S.StructField("s1", S.LongType()),
        S.StructField("s2", S.LongType()),
        S.StructField("sketch", S.ArrayType(S.LongType())),
        S.StructField("bands", S.ArrayType(S.LongType())),
    ]
)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of each document, one after another, and n + 1 offsets."""
    start, end, cut = T.words(data, offsets)
    h, off = T.windows(T.word_hashes(data, start, end), cut, k)
    doc = T.owners(off)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(offsets) - 1))]).astype(np.int64)


def minhash(sets: np.ndarray, offsets: np.ndarray, samples: int) -> np.ndarray:
    """(documents with a shingle, samples) uint32: least value of each hash function over each set."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((samples, len(starts)), dtype=np.uint32)
    if not len(starts):
        return out.T
    base = (sets >> np.uint64(32)).astype(np.uint32)
    for i in range(samples):
        out[i] = np.minimum.reduceat(base * _A[i] + _B[i], starts)
    return out.T


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """(documents, SKETCH_WORDS) uint64: the parity bitmap of (sample number, value) pairs."""
    n, k = samples.shape
    x = T.splitmix(samples.astype(np.uint64) * _ROW[:k] + _ROW[-1])
    bit = (x >> np.uint64(64 - _SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    odd = np.bincount((np.arange(n)[:, None] * _SKETCH_BITS + bit).ravel(), minlength=n * _SKETCH_BITS).reshape(n, _SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def differing_bits(similarity: float, samples: int) -> int:
    """Expected XOR population count at a similarity: 2 * samples * (1 - similarity) flips of _SKETCH_BITS bits."""
    return int(np.ceil(_SKETCH_BITS / 2 * (1 - np.exp(-4 * samples * (1 - similarity) / _SKETCH_BITS))))


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    """(documents, bands) int64: one 64-bit key for each band, which the band's number is part of."""
    rows = samples.shape[1] // bands
    x = (samples.reshape(len(samples), bands, rows).astype(np.uint64) * _ROW[:rows]).sum(2)
    return T.splitmix(x + T.splitmix(np.arange(bands, dtype=np.uint64) + _ROW[-2])).view(np.int64)


def _long_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel().view(np.int64)))


def features(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """FEATURES of every document, t a hash of its text; the empty set has no sketch and no bands."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.buffers(batch.column(1))
            for i, j in T.slices(offsets):
                sets, off = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                n = np.diff(off)
                some = np.flatnonzero(n)
                samples = minhash(sets, off, bands * rows)
                where = np.full(j - i, len(some), dtype=np.int64)
                where[some] = np.arange(len(some))
                take = pa.array(where, mask=n == 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        pa.array(n, pa.int64()),
                        pa.array(T.spans(T.splitmix(sets), off).view(np.int64)),
                        pa.array(T.spans(T.splitmix(sets ^ _ROW[7]), off).view(np.int64)),
                        _long_lists(odd_sketch(samples)).take(take) if len(some) else pa.nulls(j - i, pa.list_(pa.int64())),
                        _long_lists(band_keys(samples, bands)).take(take) if len(some) else pa.nulls(j - i, pa.list_(pa.int64())),
                    ],
                    names=FEATURES.names,
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string"))).mapInArrow(each, FEATURES)


def _xor_bits(a: str, b: str) -> F.Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, SKETCH_WORDS)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets, neither empty."""
    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _spread_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, least: int) -> DataFrame:
    """rows join table, inner, where table has one row for each key and `weight` is the number of rows with it.

    Keys of more than `least` rows are joined by broadcast; with `least` a thousandth of all rows there are at most 1,000.
    """
    own, more = rows.columns, [c for c in table.columns if c not in on]
    hot = table.where(F.col(weight) > least).withColumn("__hot", F.lit(True))
    met = rows.join(F.broadcast(hot), on, "left")
    cold = met.where("__hot is null").select(*own).join(table.where(F.col(weight) <= least), on).select(*own, *more)
    return met.where("__hot").select(*own, *more).unionByName(cold)


class _Sets:
    """Sorted uint64 sets in a binary Arrow column."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        self.data, self.at = T.buffers(column)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.data[self.at[i] : self.at[i + 1]].view(np.uint64)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    The set of a comes before the sets of its partners, once for each block of about 64 of them, so a
    hub with many partners is spread. A worker holds one hub's set and one batch.
    """
    wide = pairs.groupBy("a").agg(F.count("*").alias("n")).where("n > 64").select("a", F.ceil(F.col("n") / 64).cast("int").alias("wide"))
    blocked = pairs.select("a", "b").join(wide, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("wide", F.lit(1))).cast("int").alias("block"))
    left = blocked.select("a", "block").distinct().join(sets.withColumnRenamed("sid", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "members")
    right = blocked.join(sets.withColumnRenamed("sid", "b"), "b").select("a", "block", "b", "members")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            a, b, full = batch.column(0).to_pylist(), batch.column(2).to_pylist(), _Sets(batch.column(3))
            out = []
            for i, other in enumerate(b):
                if other is None:
                    hub = full[i]
                elif _linked(hub, full[i], percent):
                    out.append((a[i], other))
            hub = hub.copy()
            yield _pair_batch(out)

    return left.union(right).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first()).mapInArrow(test, "a long, b long")


def _pair_batch(pairs: list[tuple]) -> pa.RecordBatch:
    x = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def _labelled(pairs: DataFrame, label: DataFrame | None) -> DataFrame:
    """pairs with the components ca and cb of their ends; a node without a label is its own component."""
    if label is None:
        return pairs.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    la, lb = label.select(F.col("node").alias("a"), F.col("component").alias("ca")), label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})


class _Rows:
    """Members of buckets as arrays: key, sid, component, whether outside the main component, sketch; bands and sets if there."""

    def __init__(self, table: pa.Table, start: int = 0, stop: int | None = None):
        t = table.slice(start, None if stop is None else stop - start).combine_chunks()
        number = lambda c: t.column(c).to_numpy()
        lists = lambda c: pa.concat_arrays(t.column(c).chunks).flatten().to_numpy().reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1), np.int64)
        self.key, self.sid, self.c, self.minor = number("key"), number("sid"), number("c"), number("minor")
        self.sketch = lists("sketch").view(np.uint64)
        if "bands" in t.column_names:
            self.bands, self.sets = lists("bands"), _Sets(t.column("members"))


def _meet(x: _Rows, y: _Rows, i: np.ndarray, j: np.ndarray, most_bits: int, percent: int | None) -> np.ndarray:
    """Pairs (a, b, bits) among rows x[i] and y[j] of one or more buckets that would join their components: a forest,
    the likeliest pairs first, so there are fewer of them than components.

    With percent only pairs that are linked by their full sets, each looked at in the first bucket that it shares.
    """
    bits = np.bitwise_count(x.sketch[i] ^ y.sketch[j]).sum(1).astype(np.int64)
    ok = (bits <= most_bits) & (x.c[i] != y.c[j]) & (~y.minor[j] | (x.sid[i] < y.sid[j]))
    i, j, bits = i[ok], j[ok], bits[ok]
    if percent and len(i):
        first = (x.bands[i] == y.bands[j]).argmax(1)
        ok = x.bands[i, first] == x.key[i]
        i, j, bits = i[ok], j[ok], bits[ok]
    order = np.lexsort((y.sid[j], x.sid[i], bits))
    if not percent and len(order):  # the likeliest pair of two components is enough
        _, best = np.unique(np.stack([x.key[i], x.c[i], y.c[j]], 1)[order], axis=0, return_index=True)
        order = order[np.sort(best)]
    joined: dict[tuple, tuple] = {}

    def root(c: tuple) -> tuple:
        while (up := joined.get(c, c)) != c:
            joined[c] = joined.get(up, up)
            c = up
        return c

    keep = []
    for at, key, p, q, c, d in zip(order.tolist(), x.key[i[order]].tolist(), i[order].tolist(), j[order].tolist(), x.c[i[order]].tolist(), y.c[j[order]].tolist()):
        own = (0, c), (0, d)  # components are the same in all buckets
        if not percent:
            own = (key, c), (key, d)
        one, other = root(own[0]), root(own[1])
        if one != other and (not percent or _linked(x.sets[p], y.sets[q], percent)):
            joined[one] = other
            keep.append(at)
    i, j = x.sid[i[keep]], y.sid[j[keep]]
    return np.stack([np.minimum(i, j), np.maximum(i, j), bits[keep]], 1)


def _residual(members: DataFrame, label: DataFrame | None, reps: DataFrame, most_bits: int, percent: int | None = None, sets: DataFrame | None = None, block: int = 512) -> DataFrame:
    """Candidate pairs (a, b, bits) between different components of one bucket, over all buckets.

    Members outside a bucket's largest component meet the bucket's members. Buckets of up to `block` members
    pass through a worker sorted by key; of larger ones, blocks of about `block` rows a side meet in one
    group. What leaves a worker joins components: likely pairs, or with percent and sets links that are confirmed there.
    """
    if label is None:
        at = members.select("key", "sid", F.col("sid").alias("c"))
    else:
        at = members.join(label, members.sid == label.node, "left").select("key", "sid", F.coalesce("component", "sid").alias("c"))
    sizes = at.groupBy("key", "c").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("key").agg(F.sum("n").alias("total"), F.max(F.struct("n", F.col("c"))).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    buckets = buckets.select(
        "key", "total", F.col("top.c").alias("main"),
        F.ceil(F.col("total") / block).cast("int").alias("wide"), F.ceil((F.col("total") - F.col("top.n")) / block).cast("int").alias("tall"),
    )
    held = reps.select("sid", "sketch") if sets is None else reps.select("sid", "sketch", "bands").join(sets, "sid")
    rows = at.join(buckets, "key").join(held, "sid").withColumn("minor", F.col("c") != F.col("main"))
    own = ["key", "sid", "c", "minor", "sketch"] + ([] if sets is None else ["bands", "members"])
    part = lambda n: F.pmod(F.xxhash64("sid"), n).cast("int")
    step = 1 << 17

    def out(found: list[np.ndarray]) -> list[pa.Array]:
        x = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        return [pa.array(np.ascontiguousarray(x[:, c])) for c in range(3)]

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(t: pa.Table) -> pa.RecordBatch:
            x, found = _Rows(t), []
            begins = np.flatnonzero(np.concatenate([[True], x.key[1:] != x.key[:-1]]))
            size = np.diff(np.concatenate([begins, [len(x.key)]]))
            begin, size = np.repeat(begins, size), np.repeat(size, size)
            left = np.flatnonzero(x.minor)
            for some in np.array_split(left, int(size[left].sum() // step) + 1):
                n = size[some]
                i = np.repeat(some, n)
                j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[some], n)
                found.append(_meet(x, x, i, j, most_bits, percent))
            return pa.RecordBatch.from_arrays(out(found), names=["a", "b", "bits"])

        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            last = t.column("key")[-1] if t.num_rows else None
            cut = int(np.searchsorted(t.column("key").to_numpy(), last.as_py())) if t.num_rows else 0
            if cut:
                yield whole(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield whole(rest)

    def large(one: pa.Table, many: pa.Table) -> pa.Table:
        found = []
        if one.num_rows and many.num_rows:
            x, y = _Rows(one.rename_columns([c.removeprefix("few_") for c in one.column_names])), _Rows(many)
            for some in np.array_split(np.arange(one.num_rows), one.num_rows * many.num_rows // step + 1):
                found.append(_meet(x, y, np.repeat(some, many.num_rows), np.tile(np.arange(many.num_rows), len(some)), most_bits, percent))
        return pa.Table.from_arrays(out(found), names=["a", "b", "bits"])

    made = "a long, b long, bits long"
    low = rows.where(F.col("total") <= block).select(*own).repartition("key").sortWithinPartitions("key").mapInArrow(small, made)
    high = rows.where(F.col("total") > block)
    few = [F.col(c).alias(f"few_{c}") for c in own]
    minor = high.where("minor").select(*few, part("tall").alias("few_y"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("few_x"))
    every = high.select(*own, part("wide").alias("x"), F.explode(F.sequence(F.lit(0), F.col("tall") - 1)).alias("y"))
    met = minor.groupBy("few_key", "few_x", "few_y").cogroup(every.groupBy("key", "x", "y")).applyInArrow(large, made)
    return low.union(met)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 48, rows: int = 6, hubs: int = 2, margin: float = 0.15, path: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_shingles (set size), component_id (least doc_id reachable), kept.

    percent: least similarity of a link in hundredths. margin: by how much a sketch's estimate may fall
    short of it. path: where intermediate tables go; by default below the session's shared folder.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    samples = bands * rows
    most_bits = differing_bits(max(0.0, percent / 100 - margin), samples)
    feats = materialise(features(docs, k, bands, rows), f"{path}/features")
    hot = max(1000, feats.count() // 1000)
    owner = F.min(F.struct("doc_id", "t"))
    one = feats.where("doc_id is not null and n > 0").groupBy("s1", "s2", "n").agg(F.count("*").alias("rows"), owner.alias("owner"), F.min_by("sketch", "doc_id").alias("sketch"), F.min_by("bands", "doc_id").alias("bands"))
    reps = one.select("s1", "s2", "n", "rows", F.col("owner.doc_id").alias("doc"), F.col("owner.t").alias("t"), "sketch", "bands")
    # doc_ids of several rows: their sets are linked. A node is named by its set's least doc_id, or by the set where that one names another set
    key = F.struct("s1", "s2", "n")
    again = feats.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"), F.min(key).alias("lo"), F.max(key).alias("hi"))
    again = materialise(again.where("rows > 1").select("doc_id", "least", "most", (F.col("lo") != F.col("hi")).alias("differs")), f"{path}/again")
    differing = not again.where("differs").isEmpty()
    if differing:
        first = reps.groupBy("doc").agg(F.min(key).alias("first"), F.count("*").alias("sets"))
        reps = _spread_join(reps, first, ["doc"], "sets", hot).withColumn("sid", F.when(key == F.col("first"), F.col("doc")).otherwise(F.col("s1"))).drop("first", "sets")
    else:
        reps = reps.withColumn("sid", F.col("doc"))
    reps = materialise(reps, f"{path}/reps")
    # buckets of at least two members; a key already holds its band's number
    banded = reps.select(F.explode("bands").alias("key"), "sid")
    first = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialise(_spread_join(banded, first, ["key"], "size", hot), f"{path}/members")
    # hubs are the most central members: those whose buckets are the largest, the same few in all buckets of a group
    central = members.groupBy("sid").agg((-F.sum("size")).alias("d"))
    rest = members.join(central, "sid").select("key", "sid", F.struct("d", F.xxhash64("sid").alias("p"), F.col("sid").alias("s")).alias("rank"))
    stars = []
    for _ in range(hubs):
        best = rest.groupBy("key").agg(F.min("rank").alias("h"), F.count("*").alias("n")).where("n > 1").select("key", F.col("h.s").alias("hub"), "n")
        rest = materialise(_spread_join(rest, best, ["key"], "n", hot).where("sid <> hub").select("key", "sid", "rank", "hub"), f"{path}/stars{len(stars)}")
        stars.append(rest.select(F.least("hub", "sid").alias("a"), F.greatest("hub", "sid").alias("b")).distinct())
        rest = rest.drop("hub")
    pairs = stars[0]
    for more in stars[1:]:
        pairs = pairs.union(more)
    sketches = reps.select("sid", "sketch")
    rated = pairs.distinct().join(sketches.select(F.col("sid").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("sid").alias("b"), F.col("sketch").alias("y")), "b")
    waiting = materialise(rated.select("a", "b", _xor_bits("x", "y").cast("long").alias("bits")).where(F.col("bits") <= most_bits), f"{path}/waiting")
    # full sets, of the documents that are in some bucket
    wanted = members.select("sid").distinct().join(reps.select("sid", "s1", "doc", "t"), "sid")
    if not again.isEmpty():
        wanted = wanted.join(again.select(F.col("doc_id").alias("doc"), F.lit(True).alias("again")), "doc", "left")
    sets = materialise(_sets(docs, wanted, k), f"{path}/sets")
    links, label = None, None
    if differing:
        several = feats.where("n > 0").select("doc_id", "s1", "s2", "n").join(again.where("differs").select("doc_id"), "doc_id", "left_semi").distinct()
        several = several.join(reps.select("s1", "s2", "n", "sid"), ["s1", "s2", "n"]).select("doc_id", F.col("sid").alias("b"))
        links = _spread_join(several, several.groupBy("doc_id").agg(F.min("b").alias("a"), F.count("*").alias("sets")), ["doc_id"], "sets", hot).where("a <> b").select("a", "b")
        links = materialise(links, f"{path}/repeated")
        label = components(links, f"{path}/components")
    for step, tests in enumerate((1, 5, 8, None)):
        if tests:
            if step == 2:
                waiting = _residual(members, label, reps, most_bits)
            ends = _labelled(waiting, label).where("ca <> cb").select("a", "b", "bits", F.explode(F.array("ca", "cb")).alias("c"))
            best = W.partitionBy("c").orderBy("bits", F.xxhash64("a", "b"), "a", "b")
            chosen = ends.select("a", "b", F.row_number().over(best).alias("r")).where(F.col("r") <= tests).select("a", "b").distinct()
            passed = _confirm(materialise(chosen, f"{path}/chosen{step}"), sets, percent)
        else:
            passed = _residual(members, label, reps, most_bits, percent, sets).select("a", "b").distinct()
        passed = materialise(passed, f"{path}/passed{step}")
        if passed.isEmpty():
            continue
        links = passed if links is None else links.union(passed)
        label = components(links, f"{path}/components{step}")
    found = reps.select("s1", "s2", "n", "rows", "doc", F.col("sid").alias("c"))
    if label is not None:
        found = reps.join(label, reps.sid == label.node, "left").select("s1", "s2", "n", "rows", "doc", F.coalesce("component", "sid").alias("c"))
    if differing:  # components have names of sets among those of documents
        found = materialise(found, f"{path}/found")
        names = found.groupBy("c").agg(F.min("doc").alias("least"), F.count("*").alias("size"))
        found = _spread_join(found, names, ["c"], "size", hot).select("s1", "s2", "n", "rows", F.col("least").alias("c"))
    known = feats.select("doc_id", "n", "s1", "s2").where("n > 0 and doc_id is not null")
    out = _spread_join(known, found.select("s1", "s2", "n", "rows", "c"), ["s1", "s2", "n"], "rows", hot).select("doc_id", "n", "c")
    rest = feats.where("n = 0 or doc_id is null").select("doc_id", "n")
    mixed = again.where("least = 0 and most > 0")
    if mixed.isEmpty():
        rest = rest.withColumn("c", F.col("doc_id"))
    else:  # a document with a row without words is where its other rows are
        elsewhere = out.join(mixed.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("c").alias("c"))
        rest = rest.join(elsewhere, "doc_id", "left").select("doc_id", "n", F.coalesce("c", "doc_id").alias("c"))
    out = out.union(rest)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("c"), F.lit(True)).alias("kept"))


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(sid, members): sorted 64-bit shingle fingerprints of the wanted sets (sid, s1, doc, t), each from a row with its doc_id and text hash.

    Where wanted has a column `again`, those that it marks may have several such rows, of which one is taken.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.buffers(batch.column(2))
            for i, j in T.slices(offsets):
                sets, off = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                own = pa.array(T.spans(T.splitmix(sets), off).view(np.int64) == batch.column(1).slice(i, j - i).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([sets[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())], names=["sid", "members"]).filter(own)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("t"), text.alias("text"))
    # ids of a size that is checked go to the texts; else both sides are shuffled
    small = wanted.count() <= 1_000_000
    rows = rows.join(F.broadcast(wanted) if small else wanted, ["doc", "t"])
    if "again" in wanted.columns:
        once = rows.where("again").groupBy("sid").agg(F.any_value("s1").alias("s1"), F.any_value("text").alias("text"))
        rows = rows.where("again is null").select("sid", "s1", "text").unionByName(once)
    return rows.select("sid", "s1", "text").mapInArrow(each, "sid long, members binary")
