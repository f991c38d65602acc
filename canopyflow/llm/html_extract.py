"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A block's state is main text or not. Emissions are linear in binary features (all ancestor tags and names, the leaf's
tag, shape of the text, place on the page), transitions link neighbours. The weights maximise the
regularised likelihood of labelled pages (forward-backward, Adam); pages are decoded by Viterbi.

Defined results: null and empty html, and pages without a main block, give empty text; ties in decoding
prefer "not main"; repeated rows are extracted alike; features that training has not seen weigh nothing;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from canopyflow.llm.html_blocks import blocks
from canopyflow.llm.html_training import labelled_pages


@dataclass
class Field:
    """weights: of "main" by feature; start, end: of "main"; step: (2, 2) from state to state."""

    weights: dict[str, float]
    start: float
    end: float
    step: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, features: list[list[str]]) -> list[bool]:
        """The likeliest states, by Viterbi."""
        if not features:
            return []
        get = self.weights.get
        (s00, s01), (s10, s11) = self.step
        back: list[tuple[int, int]] = []
        a, b = 0.0, self.start + sum(get(f, 0.0) for f in features[0])
        for f in features[1:]:
            e = sum(get(x, 0.0) for x in f)
            from0, from1 = (0 if a + s00 >= b + s10 else 1), (0 if a + s01 >= b + s11 else 1)
            back.append((from0, from1))
            a, b = (a + s00 if from0 == 0 else b + s10), (a + s01 if from1 == 0 else b + s11) + e
        state = 1 if b + self.end > a else 0
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return [s == 1 for s in reversed(out)]


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, rate: float = 0.1, l2: float = 2e-4, rare: int = 3) -> Field:
    """Maximum likelihood over pages of (features of each block, labels). Features on fewer than `rare` blocks are left out."""
    pages = [p for p in pages if p[0]]
    counts: dict[str, int] = {}
    for feats, _ in pages:
        for f in feats:
            for x in f:
                counts[x] = counts.get(x, 0) + 1
    names = sorted(x for x, n in counts.items() if n >= rare)
    index = {x: k for k, x in enumerate(names)}
    n, longest = len(pages), max(len(f) for f, _ in pages)
    rows, ids, y = [], [], np.zeros((n, longest), dtype=np.int64)
    mask = np.zeros((n, longest), dtype=bool)
    for i, (feats, labels) in enumerate(pages):
        y[i, : len(labels)] = labels
        mask[i, : len(labels)] = True
        for t, f in enumerate(feats):
            known = [index[x] for x in f if x in index]
            rows += [i * longest + t] * len(known)
            ids += known
    rows, ids = np.array(rows), np.array(ids)
    last = mask.sum(1) - 1
    at = np.arange(n)
    theta = np.zeros(len(names) + 6)  # features, start, end, step of 00 01 10 11
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    true = np.zeros_like(theta)
    np.add.at(true, ids, y.ravel()[rows])
    true[-6], true[-5] = y[:, 0].sum(), y[at, last].sum()
    for t in range(1, longest):
        on = mask[:, t]
        np.add.at(true, len(names) + 2 + 2 * y[on, t - 1] + y[on, t], 1)
    for k in range(1, rounds + 1):
        w, start, end, step = theta[: len(names)], theta[-6], theta[-5], theta[-4:].reshape(2, 2)
        emit = np.zeros((n, longest, 2))
        emit[..., 1] = np.bincount(rows, w[ids], n * longest).reshape(n, longest)
        emit[:, 0, 1] += start
        emit[at, last, 1] += end
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = emit[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + step, axis=1) + emit[:, t]
        for t in range(longest - 2, -1, -1):
            go = np.logaddexp.reduce(step + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], go, 0.0)
        z = np.logaddexp.reduce(alpha[at, last], axis=1)
        post = np.exp(np.minimum(alpha + beta - z[:, None, None], 0.0)) * mask[..., None]
        want = np.zeros_like(theta)
        want[: len(names)] = np.bincount(ids, post[..., 1].ravel()[rows], len(names))
        want[-6], want[-5] = post[:, 0, 1].sum(), post[at, last, 1].sum()
        for t in range(1, longest):
            pair = alpha[:, t - 1, :, None] + step + (emit[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
            want[-4:] += (np.exp(np.minimum(pair, 0.0)) * mask[:, t, None, None]).sum(0).ravel()
        g = (want - true) / n + l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    step = theta[-4:].reshape(2, 2)
    return Field(dict(zip(names, theta[: len(names)].tolist())), float(theta[-6]), float(theta[-5]), ((float(step[0, 0]), float(step[0, 1])), (float(step[1, 0]), float(step[1, 1]))))


@lru_cache(maxsize=2)
def trained(pages: int = 1600, seed: int = 0) -> Field:
    """The field fitted to labelled_pages(pages, seed)."""
    made = []
    for page, labels in labelled_pages(pages, seed):
        found = [b.features for b in blocks(page)]
        if len(found) == len(labels):
            made.append((found, labels))
    return fit(made)


def main_text(page: str | None, model: Field) -> str:
    """Text of the main blocks in page order, joined by one space."""
    found = blocks(page)
    return " ".join(b.text for b, main in zip(found, model.decode([b.features for b in found])) if main)


def extract(pages: DataFrame, model: Field, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The keep columns of every row with text string and n_chars long (code points)."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x.as_py(), held.value) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").cast("string").alias("__html"))
    return rows.mapInArrow(run, S.StructType([*rows.schema.fields[:-1], S.StructField("text", S.StringType()), S.StructField("n_chars", S.LongType())]))
