"""Periodic runs of words by a harmonic grid of longest common extensions.

A run is a maximal stretch with smallest period q and a length of at least max(least_words, exponent * q).
A run of period p contains at least that length / p consecutive multiples of p, whatever the period, so for each p the grid points
jp and (j+1)p are the only places to look at: n/p for a period, n log n in all. Where enough neighbouring grid points hold equal words, the
longest common extension of jp and (j+1)p forward and backward gives the stretch. Extensions are range minima
over the LCP arrays of the suffix array and of the reversed words' suffix array; both are only built for documents with
such grid points. A stretch found with several periods keeps the smallest: the others are its multiples.

Slices of about 2 MB of documents are one word array, in which words of different documents differ; a longer
document is a slice of its own and needs some 60 bytes a word for both indexes. All words of a text take part.

Defined results: null text, empty text and text without words have no runs and collapse to the empty string; a null
doc_id is kept as it is; repeated rows give equal rows; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow.llm import textnp as T
from canopyflow.llm.folds import pick

_SPACES = r"[\x20\x09-\x0D]+"
RUN = "struct<start:bigint,length:bigint,period:bigint>"
#: Extensions asked for at a time.
STEP_QUERIES = 1 << 18
#: Grid points that a slice keeps between two passes; beyond it the second pass looks for them again.
MOST_HELD = 1 << 20
_FAR = np.int32(2**31 - 1)


class RangeMin:
    """Minima over ranges of an int32 array: minima from the left and from the right within blocks, and a sparse table over blocks."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        b = self.BLOCK
        padded = np.full(-(-max(1, len(values)) // b) * b, _FAR, np.int32)
        padded[: len(values)] = values
        self.rows = padded.reshape(-1, b)
        self.left = np.minimum.accumulate(self.rows, axis=1).ravel()
        self.right = np.minimum.accumulate(self.rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [self.rows.min(1)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-step], last[step:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least value in each range from lo to hi, both included."""
        b = self.BLOCK
        first, last = lo // b, hi // b
        out = np.minimum(self.right[lo], self.left[hi])
        same = np.flatnonzero(first == last)
        if len(same):
            at = np.arange(b)
            inside = (at >= (lo[same] % b)[:, None]) & (at <= (hi[same] % b)[:, None])
            out[same] = np.where(inside, self.rows[first[same]], _FAR).min(1)
        level = np.frexp((last - first - 1).clip(0).astype(np.float64))[1] - 1
        for k in np.unique(level[level >= 0]):
            some = np.flatnonzero(level == k)
            table = self.table[k]
            out[some] = np.minimum(out[some], np.minimum(table[first[some] + 1], table[last[some] - (1 << int(k))]))
        return out


class Extensions:
    """Longest common extensions of suffixes: suffix array by prefix doubling, its LCP array and their range minima.

    Two neighbours that a doubling step from h to 2h tells apart share h words and what their suffixes h further on share,
    which is a range minimum over the LCP array known so far.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n = n
        order = np.argsort(words, kind="stable").astype(np.int32)
        new = np.ones(n, bool)
        new[1:] = words[order[1:]] != words[order[:-1]]
        lcp = np.where(new, np.int32(0), _FAR)
        place = np.empty(n, np.int32)
        h = 1
        while True:
            starts = np.flatnonzero(new)
            group = np.repeat(starts, np.diff(np.append(starts, n)))  # a slot's group is named by its first slot
            place[order] = np.arange(n, dtype=np.int32)
            open_slots = np.flatnonzero(~new | np.append(~new[1:], False))
            if not len(open_slots):
                break
            far = order[open_slots].astype(np.int64) + h
            rank = np.full(len(far), -1, np.int64)
            inside = far < n
            rank[inside] = group[place[far[inside]]]
            by = np.lexsort((rank, group[open_slots]))
            rank, own = rank[by], group[open_slots]
            split = np.flatnonzero((own[1:] == own[:-1]) & (rank[1:] != rank[:-1])) + 1
            shared = np.full(len(split), h, np.int64)
            both = rank[split - 1] >= 0  # the one before sorts first, so it is the one that may have ended
            if both.any():
                table, moved = RangeMin(lcp), order[open_slots][by].astype(np.int64) + h
                a, b = place[moved[split[both] - 1]].astype(np.int64), place[moved[split[both]]].astype(np.int64)
                shared[both] += table.least(np.minimum(a, b) + 1, np.maximum(a, b))
            order[open_slots] = order[open_slots][by]
            new[open_slots[split]] = True
            lcp[open_slots[split]] = shared
            h *= 2
        self.place, self.minima = place, RangeMin(lcp)

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on (i <> j) are equal; positions at the end share none."""
        out = np.zeros(len(i), np.int64)
        inside = np.flatnonzero((i < self.n) & (j < self.n))
        a, b = self.place[i[inside]].astype(np.int64), self.place[j[inside]].astype(np.int64)
        out[inside] = self.minima.least(np.minimum(a, b) + 1, np.maximum(a, b))
        return out


def grid_pairs(words: np.ndarray, longest: int, least_words: int, exponent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(p, grid points jp) where words jp and (j+1)p are equal among as many neighbouring grid points as a run of period p must hold."""
    for p in range(1, longest // exponent + 1):
        need = max(least_words, exponent * p) // p - 1
        grid = words[::p]
        equal = grid[1:] == grid[:-1]
        if need > 1:
            many = equal[1:] & equal[:-1]
            if not many.any():
                continue
        if not equal.any():
            continue
        edge = np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - begin >= need
        if long.any():
            at = np.concatenate([np.arange(a, b) for a, b in zip(begin[long], end[long])])
            yield p, at * p


def _unknown(at: np.ndarray, p: int, known: np.ndarray) -> np.ndarray:
    """The grid points that are not, together with their successor, in a known run whose period divides p: they would give it again."""
    for start, end in known[(p % known[:, 2] == 0) & (known[:, 1] - known[:, 0] >= 2 * p), :2]:
        at = at[(at < start) | (at + p >= end)]
    return at


def runs_of(words: np.ndarray, doc: np.ndarray, longest: int, least_words: int, exponent: int) -> np.ndarray:
    """(runs, 3): start, end and period of the runs of a word array, in which documents share no word; doc numbers each word's document."""
    known = np.zeros((0, 3), np.int64)
    wanted = np.zeros(int(doc[-1]) + 1, bool)
    pairs, size = [], 0
    for p, at in grid_pairs(words, longest, least_words, exponent):
        wanted[doc[at]] = True
        size += len(at)
        if size <= MOST_HELD:
            pairs.append((p, at))
    if not size:
        return known
    # indexes of the documents in question only
    own = np.flatnonzero(wanted[doc])
    inner = np.cumsum(wanted[doc]) - 1
    n = len(own)
    forward, backward = Extensions(words[own]), Extensions(words[own][::-1])
    for p, at in pairs if size <= MOST_HELD else grid_pairs(words, longest, least_words, exponent):
        at = inner[_unknown(at, p, known)]
        for lo in range(0, len(at), STEP_QUERIES):
            a = at[lo : lo + STEP_QUERIES]
            end = a + p + forward.shared(a, a + p)
            start = a - backward.shared(n - a, n - a - p)
            long = end - start >= max(least_words, exponent * p)
            if long.any():
                found = np.unique(np.stack([own[start[long]], own[end[long] - 1] + 1, np.full(int(long.sum()), p)], 1), axis=0)
                known = np.concatenate([known, found])
    known = known[np.lexsort((known[:, 2], known[:, 1], known[:, 0]))]
    first = np.ones(len(known), bool)
    first[1:] = (known[1:, :2] != known[:-1, :2]).any(1)
    return known[first]


def _slice_runs(data: np.ndarray, offsets: np.ndarray, least_words: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start and end within the slice, period), the number of each one's document, and the word offsets."""
    start, end, cut = T.words(data, offsets)
    count = np.diff(cut)
    if not len(start):
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64), cut
    doc = T.owners(cut)
    h = T.word_hashes(data, start, end, lower=False) ^ T.splitmix(doc.astype(np.uint64) + np.uint64(1))
    words = np.unique(h, return_inverse=True)[1].astype(np.int32)
    runs = runs_of(words, doc, int(count.max()), least_words, exponent)
    return runs, doc[runs[:, 0]] if len(runs) else np.zeros(0, np.int64), cut


def find_runs(docs: DataFrame, least_words: int = 24, exponent: int = 3) -> DataFrame:
    """Per row of docs: doc_id, runs (by start, then period) and collapsed, the text without what repeats the first period of a run.

    least_words, exponent: a run has at least so many words and at least so many periods (two or more).
    """
    assert exponent >= 2 and least_words >= 2

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.buffers(batch.column(1))
            for i, j in T.slices(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                runs, of, cut = _slice_runs(part, off, least_words, exponent)
                order = np.lexsort((runs[:, 2], runs[:, 0]))
                runs, of = runs[order], of[order]
                texts = []
                for d in range(j - i):
                    words = part[off[d] : off[d + 1]].tobytes().split()
                    mine = runs[np.searchsorted(of, d) : np.searchsorted(of, d, "right")]
                    if len(mine):
                        depth = np.zeros(len(words) + 1, np.int64)
                        np.add.at(depth, mine[:, 0] + mine[:, 2] - cut[d], 1)
                        np.add.at(depth, mine[:, 1] - cut[d], -1)
                        words = [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
                    texts.append(b" ".join(words))
                fields = [pa.array(runs[:, 0] - cut[of]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(np.ascontiguousarray(runs[:, 2]))]
                spans = pa.array(np.searchsorted(of, np.arange(j - i + 1)), pa.int32())
                lists = pa.ListArray.from_arrays(spans, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(each, f"doc_id long, runs array<{RUN}>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by crc32 of the id, turns into a loop from some word on; a null id leaves the text.

    With h the checksum and g = h / 10, n words and a = g % n, word i >= a becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def spun(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(at, " ")).otherwise(F.lit(""))

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), _SPACES), lambda w: w != "")
    rows = rows.withColumn("words", F.when(h % 10 == 0, words))
    return rows.select("doc_id", F.when(F.col("words").isNotNull(), spun(F.col("words"))).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    Two different exponents of a document of fewer than 50 million words differ in double precision.
    """
    ranked = F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("x"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("n")))
    best = F.when(F.size("runs") > 0, F.array_max(ranked))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines"))
    start, length, period = -F.col("best.s"), F.col("best.n"), -F.col("best.p")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
