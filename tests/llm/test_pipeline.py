"""The pipeline's stages, each against a plain check of its decisions."""

import random

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from canopyflow.llm import byte_bpe, registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    path = tmp_path_factory.mktemp("sf")
    words = ["".join(r.choice("aeioulrstnd") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(240):
        good = r.random() < 0.8
        w = [r.choice(words) for _ in range(r.randint(20, 90))]
        text = " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w)
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 4}", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(1000 + i, rows[i][1], "en", "copy", 1) for i in range(12)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (2002, "123 456", "en", "s1", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        assert docs.columns == columns, name
        kept.append({r["doc_id"] for r in docs.collect()})
    assert not kept[0] & {2000, 2001, 2002} and len(kept[0]) == 252
    good = {r[0] for r in rows if r[1] and "!!" not in r[1] and r[0] < 2000}
    assert len(kept[1] & good) >= 0.95 * len(good) and len(kept[1] - good) <= 3
    assert kept[2] == {d for d in kept[1] if not (d >= 1000 and d - 1000 in kept[1])}
    assert kept[3] == kept[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert len(last) == docs.count() and all(r["n_tokens"] > 0 for r in last)


def test_registry():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, len(registry.queries()) + 1)]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_awkward_columns_and_repeated_ids(spark, folder, tmp_path):
    """Columns named like a stage's own, one doc_id on different texts, no labels: every stage gives the columns back."""
    path, rows = folder
    more = {"take": 1, "s": 2, "h": 3, "tokens": 4, "before": 5, "last": 6, "row": 7, "score": 8, "my col": 9, "a:b": 10}
    again = [(5, rows[7][1], "en", "s1", 1), (5, rows[9][1], "en", "s1", 1), (5, rows[9][1], "en", "s2", 2), (None, rows[11][1], "en", "s1", 1)]
    docs = spark.createDataFrame(rows + again, "doc_id long, text string, lang string, source string, n_chars long").withColumns({k: F.lit(v) for k, v in more.items()})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
        assert docs.columns == columns and docs.count() > 100, name
        assert docs.select(*[f"`{k}`" for k in more]).distinct().collect() == [tuple(more.values())], name
    assert docs.where("doc_id is null").count() > 0
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_begin_by_letting_go_of_the_stages_before(spark, folder, monkeypatch):
    released = []
    monkeypatch.setattr(corpus_pipeline, "release_shuffles", released.append, raising=False)
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[3:]:
        spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 20))
        stage(spark, docs, folder[0])
        assert released.pop() is spark and not released, name
        assert spark.conf.get("spark.sql.maxPlanStringLength") == str(byte_bpe.PLAN_CHARS)
