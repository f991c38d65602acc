"""Quality classifier by positive-unlabelled learning.

A linear model over text statistics and hashed byte pairs minimises the non-negative unbiased risk
    prior * R_P(+1) + max(0, R_U(-1) - prior * R_P(-1))
with logistic loss, from trusted positives and unlabelled web text. Labelled negatives are not used.
The class prior is estimated from the scores of a first, positive-against-unlabelled, fit.

The trusted positives of the fit are a bounded sample by hash of id and text: at most max_positive different rows (a parameter).
The unlabelled part covers every row: moments and, after the first fit, upper tails of the scores are counted over all rows; the
risk is summed over cells, each with its count and its mean features over all rows. Fixed hyperplanes make the first cells; the
next ones are levels of the scores of the fit before, as rows of like scores have like losses. So the driver
holds max_positive + LEVELS * 2 ** LEVEL_BITS feature rows, whatever the input.

Defined results: null or empty text has the all-zero features and the score these give; no positives
at all gives the score 0.5 everywhere; repeated rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from canopyflow.llm import textnp as T
from canopyflow.session import materialise, shared_dir

PAIRS = 256
#: Hyperplanes that divide the unlabelled rows into cells.
CELL_BITS = 9
#: Levels of the scores of a first fit, from -8 to 8, and hyperplanes beside them, that divide the rows for the next fit.
LEVELS, LEVEL_BITS = 128, 3
#: Groups of characters whose shares are features.
GROUPS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\f\v", "\n", ".", ",", ";:", "!", "?", "#*$%&", "|", "<>{}[]()", "@\\/_=+~^`", "'\"-"]
STATS = len(GROUPS) + 13
N_FEATURES = STATS + PAIRS

_GROUP = np.full(256, len(GROUPS), dtype=np.int64)
for _k, _chars in enumerate(GROUPS):
    for _c in _chars:
        _GROUP[ord(_c)] = _k
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, N_FEATURES) float32: shares of character groups, word and repetition statistics, hashed byte pairs."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = T.owners(offsets)
    groups = len(GROUPS) + 1
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    some = np.maximum(size, 1)[:, None]
    out[:, :groups] = np.bincount(doc * groups + _GROUP[data], minlength=n * groups).reshape(n, groups) / some
    start, end, cut = T.words(data, offsets)
    count = np.diff(cut)
    words = np.maximum(count, 1)
    length = (end - start).astype(np.float64)
    mean = T.spans(length, cut) / words
    spread = np.sqrt(np.maximum(T.spans(length**2, cut) / words - mean**2, 0))
    hashes = T.word_hashes(data, start, end)
    owner = T.owners(cut)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    begins = np.flatnonzero(fresh)
    runs = np.diff(np.append(begins, len(h)))
    kinds = np.bincount(o[begins], minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, o[begins], runs)
    once = np.bincount(o[begins[runs == 1]], minlength=n)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    shouted = _UPPER[data[start]] & _UPPER[data[np.minimum(start + 1, end - 1)]] & (end - start > 1) if len(start) else same
    odd_end = ~_ALNUM[data[end - 1]] if len(start) else same
    bare = ~_ALNUM[data[start]] & (end - start == 1) if len(start) else same
    pairs, po = T.windows(hashes, cut, 2)
    pair_owner = T.owners(po)
    order = np.lexsort((pairs, pair_owner))
    p, q = pairs[order], pair_owner[order]
    again = np.zeros(len(p), dtype=bool)
    again[1:] = (p[1:] == p[:-1]) & (q[1:] == q[:-1])
    stats = [
        np.log1p(count),
        mean / 8,
        spread / 8,
        kinds / words,
        most / words,
        once / words,
        T.spans(same, cut) / words,
        T.spans(shouted, cut) / words,
        T.spans(odd_end, cut) / words,
        T.spans(bare, cut) / words,
        np.bincount(q[again], minlength=n) / words,
        np.log1p(out[:, 4] * size),
    ]
    out[:, groups : groups + len(stats)] = np.stack(stats, 1)
    if len(data) > 1:
        left, right = data[:-1].astype(np.uint32), data[1:].astype(np.uint32)
        bucket = ((left * np.uint32(257) + right) * np.uint32(0x9E3779B1)) >> np.uint32(24)
        lane = doc[:-1]
        inside = lane == doc[1:]
        out[:, STATS:] = np.bincount((lane * PAIRS + bucket)[inside], minlength=n * PAIRS).reshape(n, PAIRS) / some
    return out


def feature_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    parts = [features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in T.slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES), np.float32)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _descend(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int, rate: float, l2: float, share: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Adam on the non-negative PU risk; where the negative part is below zero, its gradient is followed backwards.

    share: weights of the unlabelled rows, which add up to 1; by default all equal.
    """
    share = np.full(len(xu), 1 / len(xu)) if share is None else share
    w, b = np.zeros(xp.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sig = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = xp @ w + b, xu @ w + b
        sp, su = sig(zp), sig(zu)
        negative = share @ np.logaddexp(0, zu) - prior * np.logaddexp(0, zp).mean()
        gp, gu, hp = (sp - 1) * prior / len(zp), su * share, -prior * sp / len(zp)
        if negative >= 0:
            dp, du = gp + hp, gu
        else:
            dp, du = -hp, -gu
        g = np.append(dp @ xp + du @ xu + l2 * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


TAILS = np.linspace(0.02, 0.9, 45)


def prior_of_tails(p: np.ndarray, u: np.ndarray, n: int) -> float:
    """Share of positives among n unlabelled rows: the least ratio of the upper tails u of their scores to those of the positives, p."""
    return float(np.clip(np.min((u + 1.0 / np.sqrt(n)) / np.maximum(p, 1e-9), initial=1.0), 0.05, 0.99))


def estimate_prior(sp: np.ndarray, su: np.ndarray) -> float:
    """prior_of_tails() of given scores of positives and unlabelled rows."""
    at = np.quantile(sp, TAILS)
    return prior_of_tails((sp[:, None] >= at).mean(0), (su[:, None] >= at).mean(0), len(su))


def _sums(feats: DataFrame, fold: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], keys: int, width: int) -> np.ndarray:
    """(keys, width): sums over all rows of the vectors that fold gives to feature rows, by the key that it gives; added up in two steps."""
    kind = "key int, part int, v binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((keys, width)), np.zeros(keys, bool)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.float32).reshape(-1, N_FEATURES).astype(np.float64)
            for i in range(0, len(x), 4096):
                key, v = fold(x[i : i + 4096])
                order = np.argsort(key, kind="stable")
                key, v = key[order], v[order]
                begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                total[key[begin]] += np.add.reduceat(v, begin, axis=0)
                seen[key[begin]] = True
        at = np.flatnonzero(seen)
        part = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), part), pa.int32()), pa.array([total[k].tobytes() for k in at], pa.binary())], names=["key", "part", "v"])

    def add(t: pa.Table) -> pa.Table:
        v = np.sum([np.frombuffer(x, dtype=np.float64) for x in t.column(2).to_pylist()], axis=0)
        return pa.table({"key": t.column(0).slice(0, 1), "part": t.column(1).slice(0, 1), "v": pa.array([v.tobytes()], pa.binary())})

    summed = feats.select("x").mapInArrow(each, kind).groupBy("key", "part").applyInArrow(add, kind).groupBy("key").applyInArrow(add, kind)
    out = np.zeros((keys, width))
    for r in summed.collect():  # at most one row a key
        out[r["key"]] = np.frombuffer(r["v"], dtype=np.float64)
    return out


def train(docs: DataFrame, positives: DataFrame, max_positive: int = 8000, prior: float | None = None, steps: int = 400, rate: float = 0.05, l2: float = 1e-2, pair_weight: float = 0.1, path: str | None = None) -> QualityModel | None:
    """Fit from docs (doc_id, text), all of which are the unlabelled text, and positives (doc_id). None if there is no positive row.

    pair_weight: scale of the byte pairs beside the statistics. path: where the features go; by default below the shared folder.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("h"), text.alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_rows(*T.buffers(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "h", "x"])

    feats = materialise(rows.mapInArrow(extract, "doc_id long, h long, x binary"), f"{path or shared_dir(docs.sparkSession)}/features")
    ids = positives.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    known = feats.join(ids, "doc_id", "left_semi")
    # a few more than max_positive pass a threshold of their hash, so that the ranking of those reads no more whatever the input
    total = known.select("h").distinct().count()
    low = F.pmod(F.xxhash64("h"), F.lit(1 << 40)) < int(min(1.0, (1.25 * max_positive + 100) / max(1, total)) * (1 << 40))
    trusted = known.where(low).groupBy("h").agg(F.any_value("x").alias("x")).orderBy(F.pmod(F.xxhash64("h"), F.lit(1 << 40)), "h").limit(max_positive).toArrow()
    if not trusted.num_rows:
        return None
    xp = np.frombuffer(b"".join(trusted.column("x").to_pylist()), dtype=np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    one = lambda x: np.ones((len(x), 1))
    moments = _sums(feats, lambda x: (np.zeros(len(x), np.int64), np.hstack([one(x), x, x * x])), 1, 1 + 2 * N_FEATURES)[0]
    n = int(moments[0])
    mean = moments[1 : 1 + N_FEATURES] / n
    scale = np.sqrt(np.maximum(moments[1 + N_FEATURES :] / n - mean**2, 0)) + 1e-3
    scale[STATS:] /= pair_weight
    plain = lambda x: np.clip((x - mean) / scale, -8, 8)
    planes = np.random.default_rng(5).normal(size=(N_FEATURES, CELL_BITS))
    zp = plain(xp)

    def fitted(prior: float, steps: int, model: tuple[np.ndarray, float] | None) -> tuple[np.ndarray, float]:
        """A fit over cells by all hyperplanes, or by a few of them and by the scores of the fit before, which keeps apart what the loss tells apart."""

        def cell(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            z = plain(x)
            side = z @ planes > 0
            if model is None:
                key = side @ (1 << np.arange(CELL_BITS))
            else:
                level = np.clip((z @ model[0] + model[1]) * LEVELS / 16 + LEVELS / 2, 0, LEVELS - 1).astype(np.int64)
                key = level + LEVELS * (side[:, :LEVEL_BITS] @ (1 << np.arange(LEVEL_BITS)))
            return key, np.hstack([one(z), z])

        cells = _sums(feats, cell, 1 << CELL_BITS if model is None else LEVELS << LEVEL_BITS, 1 + N_FEATURES)
        cells = cells[cells[:, 0] > 0]
        return _descend(zp, cells[:, 1:] / cells[:, :1], prior, steps, rate, l2, cells[:, 0] / n)

    w, b = fitted(0.5, steps // 2, fitted(0.5, steps // 2, None))
    if prior is None:
        sp = zp @ w + b
        at = np.quantile(sp, TAILS)
        tails = _sums(feats, lambda x: (np.zeros(len(x), np.int64), ((plain(x) @ w + b)[:, None] >= at).astype(np.float64)), 1, len(at))[0] / n
        prior = prior_of_tails((sp[:, None] >= at).mean(0), tails, n)
    w, b = fitted(prior, steps, fitted(prior, steps, (w, b)))
    return QualityModel(mean, scale, w, b, prior)


def score(docs: DataFrame, model: QualityModel | None, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns of every row with score double and predicted int (1 if score >= threshold)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if held.value is None:
                s = np.full(batch.num_rows, 0.5)
            else:
                s = held.value.score(feature_rows(*T.buffers(batch.column(batch.num_columns - 1))).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*batch.schema.names[:-1], "score", "predicted"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__text"))
    return rows.mapInArrow(predict, S.StructType([*rows.schema.fields[:-1], S.StructField("score", S.DoubleType()), S.StructField("predicted", S.IntegerType())]))
