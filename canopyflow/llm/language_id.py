"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every training document: each task adds up its own counts per
(language, bucket) and Spark sums them, so the model does not depend on how rows lie. The matrix of
log probabilities (languages x buckets, a fixed size) is broadcast; scoring is numpy over Arrow
batches, without a loop over words.

Defined results: null or letterless text gives `und` with score 0; equal posteriors give the
alphabetically first language; rows with a null lang train nothing; an empty training set or no
usable language gives `und` for every row; repeated rows count as often as they occur; further
columns of the input are ignored.
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

from canopyflow.llm import textnp as T

UND = "und"
#: Bytes that the broadcast matrix may have at most.
MODEL_BYTES = 128 << 20


@dataclass
class LanguageModel:
    """Languages in alphabetical order, log prior of each, and (buckets, languages) log likelihoods."""

    languages: list[str]
    prior: np.ndarray
    likelihood: np.ndarray


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For every code point: 0 if it is no letter, else its single-character lower case."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            y = x.lower()
            out[c] = ord(y) if len(y) == 1 else c
    return out


def ngram_buckets(chars: np.ndarray, offsets: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: bucket of the n-gram that begins at each position, and whether it counts.

    Non-letters are one separator. A 1-gram is a letter, a 2-gram has a letter, a 3-gram has a letter
    in its middle; n-grams do not cross documents (a document's ends are separators).
    """
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    c = _classes()[np.minimum(chars, np.uint32(0x10FFFF))]
    padded = np.zeros(len(c) + 2, dtype=np.uint32)
    padded[:-2] = c
    one = padded[:-2] * np.uint32(0x9E3779B1)
    yield (one ^ (one >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> shift, c > 0
    second, third = padded[1:-1].copy(), padded[2:].copy()
    ends = offsets[1:] - 1
    ends = ends[(ends >= 0) & (np.diff(offsets) > 0)]
    second[ends] = 0
    third[ends] = 0
    near = ends[ends >= 1] - 1
    third[near] = 0
    two = one + second * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)
    yield (two ^ (two >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> shift, (c > 0) | (second > 0)
    three = two + third * np.uint32(0x165667B1) + np.uint32(0x3C6EF372)
    yield (three ^ (three >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> shift, second > 0


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = 1 << 16, alpha: float = 0.5) -> LanguageModel:
    """Fit on every row of docs with a non-null lang. buckets: a power of two, halved until the matrix of all
    languages is within MODEL_BYTES; alpha: added to each count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            data, offsets = T.buffers(batch.column(0))
            tags = np.array(batch.column(1).to_pylist(), dtype=object)
            for i, j in T.slices(offsets):
                chars, off = T.code_points(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = tags[i:j]
                names, which = np.unique(own.astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    seen[name] = seen.get(name, 0) + int((which == k).sum())
                    total.setdefault(name, np.zeros(buckets, dtype=np.int64))
                lane = np.repeat(which.astype(np.int64) * buckets, np.diff(off))
                for bucket, ok in ngram_buckets(chars, off, buckets):
                    n = np.bincount((lane + bucket)[ok], minlength=buckets * len(names))
                    for k, name in enumerate(names):
                        total[name] += n[k * buckets : (k + 1) * buckets]
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(n[at], seen[name]), pa.int64())],
                names=["lang", "bucket", "n"],
            )

    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("lang is not null")
    many = rows.select("lang").distinct().count()
    while many * buckets * 8 > MODEL_BYTES and buckets > 1 << 8:
        buckets >>= 1
    if many * buckets * 8 > MODEL_BYTES:
        raise ValueError(f"{many} languages exceed the bound of the broadcast matrix")
    found = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique().tolist())
    counts, docs_of = np.zeros((buckets, len(languages))), np.zeros(len(languages))
    at = found["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(dtype=np.int64)
    bucket, n = found["bucket"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.float64)
    docs_of[at[bucket < 0]] = n[bucket < 0]
    counts[bucket[bucket >= 0], at[bucket >= 0]] = n[bucket >= 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return LanguageModel(languages, np.log(docs_of / docs_of.sum()), np.log((counts + alpha) / (counts.sum(0) + alpha * buckets)))


def score(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keep columns of every row with lang_pred string and score double (posterior of that language)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.languages, model.prior, model.likelihood))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prior, likelihood = held.value
        names = np.array([*languages, UND], dtype=object)
        rows = np.vstack([likelihood, np.zeros(likelihood.shape[1])])
        for batch in batches:
            data, offsets = T.buffers(batch.column(batch.num_columns - 1))
            best, sure = [np.zeros(0, np.int64)], [np.zeros(0)]
            for i, j in T.slices(offsets):
                chars, off = T.code_points(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                letters = np.zeros(j - i, dtype=np.int64)
                total = np.tile(prior, (j - i, 1))
                for k, (bucket, ok) in enumerate(ngram_buckets(chars, off, len(likelihood))):
                    if k == 0:
                        letters = T.spans(ok, off)
                    if languages:  # what doesn't count points to a last row of zeros
                        total += T.spans(np.take(rows, np.where(ok, bucket, len(likelihood)), axis=0), off)
                if not languages:
                    best.append(np.zeros(j - i, np.int64))
                    sure.append(np.zeros(j - i))
                    continue
                top = total.max(1)
                und = letters == 0
                best.append(np.where(und, len(languages), total.argmax(1)))
                sure.append(np.where(und, 0.0, 1.0 / np.exp(total - top[:, None]).sum(1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(sure), pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    return rows.mapInArrow(predict, S.StructType([*rows.schema.fields[:-1], S.StructField("lang_pred", S.StringType()), S.StructField("score", S.DoubleType())]))
