"""The graph of nearest rows against all distances, in one block and in several."""

import numpy as np
import pytest

from canopyflow.operators import sequences as Q


@pytest.mark.parametrize("block", [16, 1000])
def test_nearest_rows_by_blocks(spark, block):
    x = np.random.default_rng(3).normal(size=(90, 5)).astype(np.float32)
    x[40:43] = x[40]  # ties
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<float>")
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(-1))
    want = {}
    for a in range(90):
        for b in sorted((b for b in range(90) if b != a), key=lambda b: (d[a, b], b))[:4]:
            want[a, b] = want[b, a] = 1 / (d[a, b] + 1e-8)
    got = {(r.a, r.b): r.weight for r in Q.knn_graph(frame, "id", "v", 4, block).collect()}
    assert got.keys() == want.keys()
    assert all(got[e] == pytest.approx(w, rel=1e-5) for e, w in want.items() if d[e] > 1e-3)


def test_a_row_is_copied_for_every_block_once(spark):
    rows = spark.range(64).selectExpr("id", "array(cast(id as float)) v")
    plan = Q.knn_graph(rows, "id", "v", 4, 16)._jdf.queryExecution().executedPlan().toString()
    # each side goes only to blocks from, or up to, its own, and the distances are in the plan once
    assert plan.count("Generate explode(sequence(") == 2 and "sequence(0, 3" not in plan and plan.count("FlatMapCoGroupsInPandas") == 1
