"""Every registered query against its DuckDB SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from canopyflow.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.7g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).columns


def test_label_queries_take_all_rows(spark, monkeypatch):
    from canopyflow.operators import evaluation as E

    seen, plain = {}, E.random_forest
    # the forest's own size is looked at here and fitted small
    monkeypatch.setattr(E, "random_forest", lambda train, features, label, **own: seen.update(n=len(features), own=own) or plain(train, features, label, **(own | {"trees": 3, "depth": 3})))
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = catalog.queries()["m2_random_forest"](spark, SF)
    assert {r["label"] for r in got.select("label").distinct().collect()} == {0.0, 1.0}
    assert got.join(e.select("vec_id", e.label.alias("of")), "vec_id").select("of").distinct().count() == e.select("label").distinct().count()
    assert seen == {"n": len(e.first()["embedding"]), "own": {}}
    spread = catalog.queries()["x21_label_spreading"](spark, SF)
    assert spread.count() == e.count()


def test_entry(spark):
    import __spark_entry__

    assert set(SQL) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
