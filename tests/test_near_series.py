"""Pairs of series meet in blocks, not row by row."""

import numpy as np
import pytest

from canopyflow.operators import clustering as C
from canopyflow.operators import sequences as Q


@pytest.mark.parametrize("window", [0, 2])
def test_blocks_meet_once(spark, window):
    r = np.random.default_rng(7)
    series = [(f"t{i}", r.normal(size=int(r.choice([4, 5]))).cumsum().tolist()) for i in range(60)]
    frame = spark.createDataFrame(series, "tree string, v array<double>")
    found = C.dtw_pairs(frame, "tree", ["v"], window, 2.0, block=9)
    got = {(x.tree, x.tree_b): x.distance for x in found.collect()}
    want = {(min(k, m), max(k, m)): Q.dtw(np.array(v), np.array(u), window) for i, (k, v) in enumerate(series) for m, u in series[:i]}
    want = {k: d for k, d in want.items() if d <= 2.0}
    assert got.keys() == want.keys() and found.count() == len(want) and all(abs(got[k] - d) < 1e-12 for k, d in want.items())
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
