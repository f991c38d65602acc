"""Word, window and code-point kernels against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from canopyflow.llm import textnp as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(n):
    r = random.Random(1)
    parts = ["", " ", "a", "A b", None, "é ü x", "\n\tAB ab aB ", "x " * 9, "😀 ok", "a\x0bb\x0cc\rd"]
    return ["".join(p for p in r.choices(parts, k=r.randint(0, 5)) if p) if r.random() > 0.05 else None for _ in range(n)]


@pytest.mark.parametrize("cut", [(0, 400), (7, 391)])
@pytest.mark.parametrize("k", [1, 2, 4, 5])
def test_words_and_windows(cut, k):
    column = pa.array(texts(400))[slice(*cut)]
    data, off = T.buffers(column)
    start, end, at = T.words(data, off)
    h = T.word_hashes(data, start, end)
    w, wo = T.windows(h, at, k)
    seen = {}
    for i, t in enumerate(column.to_pylist()):
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        assert [bytes(data[a:b]).decode() for a, b in zip(start[at[i] : at[i + 1]], end[at[i] : at[i + 1]])] == WORD.findall(t or "")
        want = [tuple(words[j : j + k]) for j in range(len(words) - k + 1)] if len(words) >= k else [tuple(words)] if words else []
        assert len(want) == wo[i + 1] - wo[i]
        for x, y in zip(want, w[wo[i] : wo[i + 1]]):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def test_code_points_and_empty():
    data, off = T.buffers(pa.array(["aé😀", None, "", "z"]))
    chars, o = T.code_points(data, off)
    assert [chr(c) for c in chars] == ["a", "é", "😀", "z"] and o.tolist() == [0, 3, 3, 3, 4]
    data, off = T.buffers(pa.array([], pa.string()))
    assert len(data) == 0 and off.tolist() == [0]
    assert T.spans(np.array([1, 2, 3]), np.array([0, 0, 2, 2, 3])).tolist() == [0, 3, 0, 3]
