"""Language-model scoring by deleted interpolation.

The probability of a token w after its context u is mixed from maximum-likelihood estimates of falling order,
    P(w | u) = l2 * c(u, w) / c(u) + l1 * c(w) / N + l0 * (c(w) + 0.5) / (N + 0.5 * (V + 1)),
with mixture weights (l2, l1, l0) of the bucket that the context's frequency c(u) falls into (powers of
two). The weights are learned by expectation-maximisation on held-out counts: every training token is
held out of its own counts in turn, so c(u, w), c(u), c(w) and N are each less by one. Tokens are the
lower-cased (A-Z) words [^\\x20\\x09-\\x0D]+ and one end token for each text; the context of a text's first token
is the start.

Counts are those of the whole training part and live in shuffles, not on the driver:
1. One pass cuts the documents into chunks of bounded size (a longer text is a chunk of its own) and
   writes each as its sorted distinct word fingerprints and its tokens as positions in that list.
2. Each chunk asks for the totals of its distinct words, later of its distinct pairs: a request is a sorted list
   of 64-bit fingerprints with the chunk's own training counts, cut by fingerprint range; the task of a
   range adds the counts of all chunks up and answers each with the totals of what it asked for.
3. A chunk joins its answers and then knows every count that its tokens need. Its tokens' held-out
   estimates, binned on a fixed grid, are what the weights are fitted to; with the weights it scores.

A frequent pair is one entry in each chunk's list, so no key gathers rows.

Defined results: null and empty text have the end token only; with no training text at all, V and N are 0
and every probability is 1 (score 0); repeated rows are counted and scored as often as they occur; rows with
a null id are scored too; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyflow.llm import textnp as T
from canopyflow.session import materialise, release_shuffles, shared_dir

U = np.uint64
#: Fingerprints of the end token and of the start of a text; no word has them but by chance.
END, START = U(0x1F3D5B79A8C6E4F1), U(0x7B1E9D3C5A2F8641)
_LEFT, _RIGHT = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)
#: Half octaves of the grid that held-out estimates are binned on, for each of the two ratios.
GRID = 160
BUCKETS = 40


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """x (of rising numbers: their differences) as byte planes, compressed: the planes of high bytes are mostly zero."""
    if rising and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes, n: int, kind: type, rising: bool = False) -> np.ndarray:
    """The n numbers that pack() was given."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    x = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=kind) if rising else x


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return T.splitmix(left * _LEFT + T.splitmix(right * _RIGHT))


def chunks(docs: DataFrame, training: Column, chunk_bytes: int = 2 << 20) -> DataFrame:
    """One row a chunk: chunk string, ids (nullable longs), train flags, token counts, vocabulary and token positions, each packed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in batches:
            data, offsets = T.buffers(batch.column(1))
            ids, train = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            known = np.asarray(ids.is_valid()).astype(np.uint8)
            ids = ids.fill_null(0).to_numpy().astype(np.int64)
            for i, j in T.slices(offsets, chunk_bytes):
                hashes, sizes = [], []
                for a, b in T.slices(offsets[i : j + 1]):
                    a, b = a + i, b + i
                    raw, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    start, end, at = T.words(raw, off)
                    n = np.diff(at)
                    full = np.full(len(start) + len(n), END, dtype=np.uint64)
                    place = np.ones(len(full), dtype=bool)
                    place[at[1:] + np.arange(len(n))] = False
                    full[place] = T.word_hashes(raw, start, end)
                    hashes.append(full)
                    sizes.append(n + 1)
                tokens, size = np.concatenate(hashes), np.concatenate(sizes).astype(np.int32)
                vocabulary, position = np.unique(tokens, return_inverse=True)
                row = [uuid.uuid4().hex, ids[i:j].tobytes(), known[i:j].tobytes(), train[i:j].tobytes(), size.tobytes(), pack(vocabulary, True), pack(position.astype(np.uint32)), len(vocabulary), len(tokens)]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["chunk", "ids", "known", "train", "size", "vocabulary", "position", "words", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(training, F.lit(False)))
    return rows.mapInArrow(cut, "chunk string, ids binary, known binary, train binary, size binary, vocabulary binary, position binary, words long, tokens long")


class Chunk:
    """The unpacked arrays of a chunk."""

    def __init__(self, r):
        self.train = np.frombuffer(r["train"], np.uint8).astype(bool)
        self.size = np.frombuffer(r["size"], np.int32).astype(np.int64)
        self.vocabulary = unpack(r["vocabulary"], r["words"], np.uint64, True)
        self.position = unpack(r["position"], r["tokens"], np.uint32).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.size)])
        self.train_token = np.repeat(self.train, self.size)

    def context(self) -> np.ndarray:
        """Position in the vocabulary of each token's context; the start is len(vocabulary)."""
        left = np.empty_like(self.position)
        left[1:] = self.position[:-1]
        left[self.offsets[:-1]] = len(self.vocabulary)
        return left

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct pair fingerprints, and each token's position among them."""
        words = np.append(self.vocabulary, START)
        return np.unique(pair_keys(words[self.context()], self.vocabulary[self.position]), return_inverse=True)


def _requests(table: DataFrame, parts: int, pairs: bool) -> DataFrame:
    """(part, chunk, keys, counts): what a chunk asks for, by range of the fingerprint; counts are its own training counts."""
    edges = np.array([((p << 64) // parts) for p in range(1, parts)], dtype=np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = Chunk(r)
                keys, at = c.pairs() if pairs else (c.vocabulary, c.position)
                own = np.bincount(at[c.train_token], minlength=len(keys)).astype(np.uint32)
                cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                for p in range(parts):
                    a, b = cut[p], cut[p + 1]
                    if b > a:
                        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([r["chunk"]]), pa.array([pack(keys[a:b], True)], pa.binary()), pa.array([pack(own[a:b])], pa.binary()), pa.array([b - a], pa.int64())], names=["part", "chunk", "keys", "counts", "n"])

    return table.select("chunk", "train", "size", "vocabulary", "position", "words", "tokens").mapInArrow(ask, "part int, chunk string, keys binary, counts binary, n long")


def _answers(requests: DataFrame) -> DataFrame:
    """(chunk, part, totals, n, kinds, tokens): totals over all chunks of what a chunk asked for, in its order.

    kinds and tokens, on one row of each part, are the part's distinct training keys and its training total.
    """

    def add(group: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(k, n, np.uint64, True) for k, n in zip(group["keys"], group["n"])]
        counts = [unpack(c, n, np.uint32) for c, n in zip(group["counts"], group["n"])]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(every)).astype(np.uint32)
        cut = np.cumsum([0, *map(len, keys)])
        out = pd.DataFrame({"chunk": group["chunk"], "part": group["part"], "n": group["n"]})
        out["totals"] = [pack(total[at[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
        out["kinds"], out["tokens"] = 0, 0
        out.iloc[0, out.columns.get_loc("kinds")] = int((total > 0).sum())
        out.iloc[0, out.columns.get_loc("tokens")] = int(total.sum(dtype=np.int64))
        return out[["chunk", "part", "n", "totals", "kinds", "tokens"]]

    return requests.groupBy("part").applyInPandas(add, "chunk string, part int, n long, totals binary, kinds long, tokens long")


def _gathered(group: pd.DataFrame) -> np.ndarray:
    group = group.sort_values("part")
    return np.concatenate([unpack(t, n, np.uint32) for t, n in zip(group["totals"], group["n"])]).astype(np.float64)


class Estimates:
    """Per token of a chunk: the three estimates, and the context's frequency."""

    def __init__(self, chunk: Chunk, words: np.ndarray, pair: np.ndarray, kinds: int, total: int, texts: int, held_out: bool):
        _, at = chunk.pairs()
        left = chunk.context()
        own = chunk.position
        less = chunk.train_token.astype(np.float64) if held_out else 0.0
        context = np.append(words, float(texts))  # the start is the context of each training text's first token
        self.frequency = np.maximum(context[left] - less, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.two = np.where(self.frequency > 0, (pair[at] - less) / self.frequency, 0.0)
            self.one = np.where(total - less > 0, (words[own] - less) / (total - less), 0.0)
            self.none = (words[own] - less + 0.5) / np.maximum(total - less + 0.5 * (kinds + 1), 0.5)
        self.bucket = np.minimum(np.where(self.frequency > 0, np.log2(np.maximum(self.frequency, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)


def fit_weights(cells: np.ndarray, rounds: int = 80) -> np.ndarray:
    """(BUCKETS, 3) mixture weights by EM. cells: bucket, log2 ratios x2 and x1 to the lowest estimate (-inf: zero), tokens."""
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weights[0] = [0.0, 0.6, 0.4]
    if not len(cells):
        return weights
    bucket, n = cells[:, 0].astype(np.int64), cells[:, 3]
    ratio = np.column_stack([np.exp2(cells[:, 1]), np.exp2(cells[:, 2]), np.ones(len(cells))])
    for _ in range(rounds):
        part = weights[bucket] * ratio
        part *= (n / part.sum(1))[:, None]
        new = np.stack([np.bincount(bucket, part[:, k], BUCKETS) for k in range(3)], 1)
        mass = new.sum(1)
        weights = np.where(mass[:, None] > 0, new / np.maximum(mass, 1e-300)[:, None], weights)
    return (weights + 1e-6 * np.array([0.0, 0.0, 1.0])) / (1 + 1e-6)


def _bins(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Half octaves of upper / lower from -GRID / 4 octaves on, 0 for zero."""
    with np.errstate(divide="ignore"):
        x = np.where(upper > 0, np.log2(upper / lower), -np.inf)
    return np.where(upper > 0, np.clip(np.floor(np.maximum(x, -1e3) * 4) + GRID / 4, 1, GRID - 1), 0).astype(np.int64)


def _centre(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, (b - GRID / 4 + 0.5) / 4, -np.inf)


def score(docs: DataFrame, training: Column, chunk_bytes: int = 2 << 20, path: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    training: Boolean column over docs, the rows to learn from. chunk_bytes: text that one chunk holds.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    table = materialise(chunks(docs, training, chunk_bytes), f"{path}/chunks")
    size = table.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    # a part of the requests holds at most about 8 MB of fingerprints
    words = materialise(_answers(_requests(table, max(4, size["words"] >> 20), False)), f"{path}/words")
    pairs = materialise(_answers(_requests(table, max(8, size["tokens"] >> 20), True)), f"{path}/pairs")
    release_shuffles(spark)
    sums = words.agg(F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    kinds, total = int(sums["kinds"]), int(sums["tokens"])
    texts = docs.where(F.coalesce(training, F.lit(False))).count()
    answers = words.select("chunk", "part", "n", "totals", F.lit(1).alias("order")).union(pairs.select("chunk", "part", "n", "totals", F.lit(2).alias("order")))

    def joined(body, schema: str) -> DataFrame:
        def run(one: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            r = one.iloc[0]
            c = Chunk(r)
            return body(r, c, _gathered(got[got["order"] == 1]), _gathered(got[got["order"] == 2]))

        return table.groupBy("chunk").cogroup(answers.withColumnRenamed("chunk", "of").groupBy("of")).applyInPandas(run, schema)

    def bins(r, c: Chunk, w: np.ndarray, p: np.ndarray) -> pd.DataFrame:
        e = Estimates(c, w, p, kinds, total, texts, True)
        t = c.train_token
        cell = ((e.bucket * GRID + _bins(e.two, e.none)) * GRID + _bins(e.one, e.none))[t]
        values, n = np.unique(cell, return_counts=True)
        return pd.DataFrame({"cell": values.astype(np.int64), "n": n.astype(np.int64)})

    grid = joined(bins, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS x GRID x GRID cells
    cell = grid["cell"].to_numpy(np.int64)
    release_shuffles(spark)
    cells = np.column_stack([cell // (GRID * GRID), _centre(cell // GRID % GRID), _centre(cell % GRID), grid["n"].to_numpy(np.float64)])
    weights = fit_weights(cells[np.lexsort(cells.T)] if len(cells) else cells)

    def final(r, c: Chunk, w: np.ndarray, p: np.ndarray) -> pd.DataFrame:
        e = Estimates(c, w, p, kinds, total, texts, False)
        by = weights[e.bucket]
        mixed = by[:, 0] * e.two + by[:, 1] * e.one + by[:, 2] * e.none
        base = np.log10(e.none) if total else np.zeros(len(e.none))
        model = np.log10(mixed) if total else np.zeros(len(e.none))
        known = np.frombuffer(r["known"], np.uint8).astype(bool)
        ids = pd.array(np.frombuffer(r["ids"], np.int64).copy(), dtype="Int64")
        ids[~known] = pd.NA
        return pd.DataFrame(
            {"doc_id": ids, "n_tokens": c.size, "n_known": T.spans((w[c.position] > 0).astype(np.int64), c.offsets), "train_tokens": total, "base_score": T.spans(base, c.offsets), "score": T.spans(model, c.offsets)}
        )

    return joined(final, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
