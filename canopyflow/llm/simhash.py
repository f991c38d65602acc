"""SimHash near-duplicate detection by the generalised pigeonhole principle.

1. One pass over the texts gives each document its 64-bit fingerprint: bit b is 1 if it is set in over half of the
   XXH64 values (seed 42) of the document's k-word shingles, repeats included. Equal fingerprints become one node.
2. Counts of single bits and of pairs of bits over all fingerprints group correlated bits into partitions, so that
   some partitions are crowded and others tell much.
3. With m partitions and `most_bits` differing bits, thresholds t_i >= -1 whose sum is most_bits - m + 1 miss nothing:
   every pair has a partition with at most t_i differing bits (-1: the partition is not asked). For each fingerprint
   a dynamic programme over the partitions chooses the thresholds with the least estimated cost. The candidates that a threshold
   gives are estimated from histograms of parts of at most eight bits, counted over all fingerprints and convolved.
4. Each fingerprint lies in its bucket of every partition and probes the buckets within its thresholds. Probes
   and members meet in a bucket, are verified on all 64 bits, and leave as stars: at most a link a row, whatever the links.
5. A bucket of more than `cap` rows is split: its pairs differ in at most most_bits of the bits that are not in its key, so
   they agree on one of most_bits + 1 parts of those. The rest of the bits shrinks with every split, and so do the buckets.

Defined results: null text, empty text and text without words have the fingerprint zero and link like any
other; fewer than k words give the whole sequence as one shingle; rows with one doc_id are one document, so
their fingerprints are linked; rows with a null doc_id link like others, but give no component its name: where no row of a component has an id
it is null; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflow.llm import textnp as T
from canopyflow.llm.folds import pick
from canopyflow.llm.near_dedup import _spread_join
from canopyflow.operators.components import components
from canopyflow.session import materialise, shared_dir

BITS = 64
SEED = 42
#: Shingles hashed at a time, so that a long text needs little more memory than its words.
STEP_SHINGLES = 1 << 16
#: Pairs verified at a time.
STEP_PAIRS = 1 << 20
#: What a probe costs, counted in verified candidates.
PROBE_COST = 64.0
#: Bits of a part whose values are counted.
PART_BITS = 8
DATA, PROBE = 1, 2
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ONE = np.uint64(1)


def fingerprint(text: bytes, k: int) -> int:
    """The SimHash of a UTF-8 text, as an unsigned number."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    wide = min(k, len(words))
    first, last = begin[: len(words) - wide + 1].tolist(), end[wide - 1 :].tolist()
    ones, n = np.zeros(BITS, np.int64), len(first)
    hashed = xxhash.xxh64_intdigest
    for i in range(0, n, STEP_SHINGLES):
        spans = zip(first[i : i + STEP_SHINGLES], last[i : i + STEP_SHINGLES])
        h = np.array([hashed(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.buffers(batch.column(1))
            fp = np.fromiter((fingerprint(data[a:b].tobytes(), k) for a, b in zip(offsets[:-1], offsets[1:])), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """(64, 64): how many fingerprints have both bits; the diagonal counts single bits."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 1 << 16):
                x = _bits(fp[i : i + (1 << 16)]).astype(np.float32)
                both += (x.T @ x).astype(np.int64)
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both.ravel()[at])], names=["at", "n"])

    out = np.zeros(BITS * BITS)
    for r in nodes.select("fp").mapInArrow(each, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 4,096
        out[r["at"]] = r["n"]
    return out.reshape(BITS, BITS)


def group_bits(both: np.ndarray, total: int, m: int) -> list[list[int]]:
    """m partitions of the bits: each begins with the bit most correlated to what is left and takes its most correlated companions."""
    p = np.diag(both) / max(1, total)
    spread = np.sqrt(p * (1 - p))
    phi = np.abs((both / max(1, total) - np.outer(p, p)) / np.maximum(np.outer(spread, spread), 1e-12))
    np.fill_diagonal(phi, 0)
    left, groups = list(range(BITS)), []
    for g in range(m):
        own: list[int] = []
        for _ in range(BITS // m + (g < BITS % m)):
            near = phi[np.ix_(left, own or left)].sum(1)
            own.append(left.pop(int(near.argmax())))
        groups.append(own)
    return groups


def _mask(bits: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def _value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits' values packed into small integers."""
    return sum((((fp >> np.uint64(b)) & _ONE).astype(np.int64) << j for j, b in enumerate(bits)), np.zeros(len(fp), np.int64))


def part_counts(nodes: DataFrame, parts: list[list[int]]) -> np.ndarray:
    """(parts, 2 ** PART_BITS): how many fingerprints have each value of each part."""
    wide = 1 << PART_BITS

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(parts), wide), np.int64)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s, bits in enumerate(parts):
                seen[s] += np.bincount(_value(fp, bits), minlength=wide)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen.ravel()[at])], names=["at", "n"])

    out = np.zeros(len(parts) * wide)
    for r in nodes.select("fp").mapInArrow(each, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 2,560
        out[r["at"]] = r["n"]
    return out.reshape(len(parts), wide)


class Partitioning:
    """Partitions of the bits with what is needed to allocate thresholds to a fingerprint."""

    def __init__(self, groups: list[list[int]], most_bits: int, total: int):
        self.groups, self.most_bits, self.total = groups, most_bits, total
        self.masks = [_mask(g) for g in groups]
        self.parts = [[g[i : i + PART_BITS] for i in range(0, len(g), PART_BITS)] for g in groups]
        self.near: list[list[np.ndarray]] = []
        #: For each partition and distance, the masks that flip so many of its bits.
        self.flips = [[np.array([_mask(list(c)) for c in combinations(g, d)], np.uint64) for d in range(most_bits + 1)] for g in groups]

    def count(self, nodes: DataFrame) -> Partitioning:
        counts = part_counts(nodes, [p for g in self.parts for p in g])
        values = np.arange(1 << PART_BITS, dtype=np.uint64)
        apart = np.bitwise_count(values[:, None] ^ values[None, :])
        share, at = [np.stack([(apart == d) @ c for d in range(self.most_bits + 1)], 1) / max(1, self.total) for c in counts], 0
        for g in self.parts:
            self.near.append(share[at : at + len(g)])
            at += len(g)
        return self

    def costs(self, fp: np.ndarray) -> np.ndarray:
        """(fingerprints, partitions, most_bits + 2): estimated cost of each threshold, from -1."""
        out = np.zeros((len(fp), len(self.groups), self.most_bits + 2))
        for i, (parts, near, flips) in enumerate(zip(self.parts, self.near, self.flips)):
            d = np.zeros((len(fp), self.most_bits + 1))
            d[:, 0] = 1
            for bits, table in zip(parts, near):
                own = table[_value(fp, bits)]
                d = np.stack([sum(d[:, a] * own[:, t - a] for a in range(t + 1)) for t in range(self.most_bits + 1)], 1)
            probes = np.cumsum([len(x) for x in flips])
            out[:, i, 1:] = self.total * np.cumsum(d, 1) + PROBE_COST * probes
        return out

    def allocate(self, fp: np.ndarray) -> np.ndarray:
        """(fingerprints, partitions): thresholds with the least cost among those whose sum is most_bits - partitions + 1."""
        cost, units = self.costs(fp), self.most_bits + 1  # a partition's units are its threshold plus one
        n, m, _ = cost.shape
        best, chosen = np.full((n, units + 1), np.inf), np.zeros((m, n, units + 1), np.int64)
        best[:, 0] = 0
        for i in range(m):
            ways = np.full((n, units + 1, units + 1), np.inf)
            for s in range(units + 1):
                for u in range(s + 1):
                    ways[:, s, u] = best[:, s - u] + cost[:, i, u]
            chosen[i], best = ways.argmin(2), ways.min(2)
        left, out = np.full(n, units), np.zeros((n, m), np.int64)
        for i in reversed(range(m)):
            u = chosen[i, np.arange(n), left]
            out[:, i], left = u - 1, left - u
        return out

    def rows(self, fp: np.ndarray) -> list[np.ndarray]:
        """key, fp, rest (mask of the bits outside the key), role: each fingerprint in all its buckets, and its probes of others."""
        out, limits = [], self.allocate(fp)
        for i, mask in enumerate(self.masks):
            salt, own = T.splitmix(np.array([i + 1], np.uint64))[0], fp & mask
            out.append((T.splitmix(own ^ salt), fp, mask, np.where(limits[:, i] >= 0, DATA | PROBE, DATA)))
            for d in range(1, self.most_bits + 1):
                some = limits[:, i] >= d
                if some.any():
                    keys = T.splitmix((own[some][:, None] ^ self.flips[i][d][None, :]) ^ salt)
                    out.append((keys.ravel(), np.repeat(fp[some], keys.shape[1]), mask, np.full(keys.size, PROBE)))
        return [np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), np.concatenate([np.full(len(x[0]), ~x[2]) for x in out]), np.concatenate([x[3] for x in out])]


ROWS = "key long, fp long, rest long, role long"


def _row_batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names=["key", "fp", "rest", "role"])


def signatures(nodes: DataFrame, by: Partitioning) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 1 << 12):
                yield _row_batch(by.rows(fp[i : i + (1 << 12)]))

    return nodes.select("fp").mapInArrow(each, ROWS)


def split(rows: DataFrame, ways: int) -> DataFrame:
    """Each row in `ways` smaller buckets, by as many parts of the bits that its key does not hold yet."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, rest = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in range(3))
            role = batch.column(3).to_numpy(zero_copy_only=False)
            for mask in np.unique(rest):
                some = rest == mask
                bits = [b for b in range(BITS) if (int(mask) >> b) & 1]
                for j in range(ways):
                    part = _mask(bits[j::ways])
                    salt = T.splitmix(np.array([j + 101], np.uint64))[0]
                    keys = T.splitmix(key[some] ^ T.splitmix((fp[some] & part) ^ salt))
                    yield _row_batch([keys, fp[some], np.full(len(keys), mask & ~part), role[some]])

    return rows.mapInArrow(each, ROWS)


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least labels after joining the pairs (a, b)."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label != (up := label[label])).any():
            label = up


def meet(key: np.ndarray, fp: np.ndarray, role: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the links between probes and members of whole buckets, which lie together."""
    n = len(key)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([begin, [n]]))
    first, size = np.repeat(begin, size), np.repeat(size, size)
    probes = np.flatnonzero((role & PROBE > 0) & (size > 1))
    reach = np.cumsum(size[probes])
    label = np.arange(n)
    for lo, hi in T.slices(np.concatenate([[0], reach]), STEP_PAIRS):
        some = probes[lo:hi]
        wide = size[some]
        i = np.repeat(some, wide)
        j = np.arange(len(i)) - np.repeat(np.cumsum(wide) - wide, wide) + np.repeat(first[some], wide)
        ok = (np.bitwise_count(fp[i] ^ fp[j]) <= most_bits) & (role[j] & DATA > 0) & (i != j)
        label = merged(label, i[ok], j[ok])
    leaf = np.flatnonzero(label != np.arange(n))
    return fp[label[leaf]], fp[leaf]


def links(rows: DataFrame, most_bits: int) -> DataFrame:
    """(a, b): links of the buckets, which are sorted by key and pass through a worker; a worker holds one bucket and one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(columns: list[np.ndarray]) -> pa.RecordBatch:
            a, b = meet(columns[0], columns[1].view(np.uint64), columns[2], most_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, (0, 1, 3))]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield out([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield out(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(each, "a long, b long")


def near_links(nodes: DataFrame, most_bits: int = 2, cap: int = 4096, partitions: int | None = None, path: str | None = None) -> DataFrame:
    """(a, b) over distinct fingerprints `fp`: links whose components are those of all pairs with at most most_bits differing bits."""
    path = path or shared_dir(nodes.sparkSession)
    total = nodes.count()
    m = partitions or int(np.clip(round(BITS / np.log2(max(total, 4))), 2, most_bits + 2))
    by = Partitioning(group_bits(bit_counts(nodes), total, m), most_bits, total).count(nodes)
    rows, found, level = materialise(signatures(nodes, by), f"{path}/rows0"), None, 0
    while True:
        large = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cap), f"{path}/large{level}")
        last = large.isEmpty()
        small = rows if last else rows.join(large, "key", "left_anti")
        one = materialise(links(small, most_bits), f"{path}/links{level}")
        found = one if found is None else found.union(one)
        if last:
            return found
        level += 1
        rows = materialise(split(_spread_join(rows, large, ["key"], "n", max(cap, m * total // 1000)).select("key", "fp", "rest", "role"), most_bits + 1), f"{path}/rows{level}")


def near_duplicates(docs: DataFrame, k: int = 3, most_bits: int = 2, cap: int = 4096, partitions: int | None = None, path: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 lowercase hexadecimal digits), component_id (least doc_id reachable).

    cap: rows from which a bucket is split. partitions: how many partitions of the bits; by default as many as give
    each fingerprint about one bucket of its own. path: where intermediate tables go; by default below the session's shared folder.
    """
    path = path or shared_dir(docs.sparkSession)
    rows = materialise(fingerprints(docs, k), f"{path}/fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least")), f"{path}/nodes")
    joined = near_links(nodes, most_bits, cap, partitions, f"{path}/near")
    # a doc_id on several fingerprints is one document
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("doc_id", "a")
    joined = joined.union(rows.select("doc_id", F.col("fp").alias("b")).distinct().join(several, "doc_id").where("a <> b").select("a", "b"))
    label = components(joined, f"{path}/components")
    named = nodes.join(label, nodes.fp == label.node, "left").select("fp", "rows", "least", F.coalesce("component", "fp").alias("c"))
    named = materialise(named, f"{path}/named")
    names = named.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    total = max(1000, nodes.count() // 1000)
    owner = materialise(_spread_join(named, names, ["c"], "size", total).select("fp", "rows", "component_id"), f"{path}/owner")
    out = _spread_join(rows, owner, ["fp"], "rows", total)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
