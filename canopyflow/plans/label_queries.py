"""Name, label, split and metric queries (B, J, M) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflow.functions import names as N
from canopyflow.operators import evaluation as E
from canopyflow.plans.catalog import register
from canopyflow.plans.series_queries import r9, rounded
from canopyflow.session import table

BASE_SQL = "b AS (SELECT d.doc_id, d.source, d.lang, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic, CASE WHEN d.lang = 'en' THEN 1 WHEN d.lang = 'de' THEN 0 ELSE -1 END AS rule FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def base(spark: SparkSession, sf: str) -> DataFrame:
    rule = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 0).otherwise(-1)
    return E.label_join(table(spark, sf, "documents").select("doc_id", "source", "lang"), table(spark, sf, "labels"), "doc_id", ["quality", "toxic"]).withColumn("rule", rule)


@register("b1_stem_dates", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(ts::DATE AS VARCHAR) END AS flight FROM events")
def b1(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    stem = F.concat(F.lit("lhc_"), F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "dd-MM-yy")).when(F.col("event_id") % 3 == 1, "dateUnknown").otherwise("31-02-24"))
    return e.select("event_id", N.stem_date(stem).cast("string").alias("flight"))


@register("b4_threshold_tags", "SELECT l_orderkey, l_linenumber, 'conf_0p' || lpad(CAST(round(l_discount * 100) AS INTEGER)::VARCHAR, 2, '0') AS tag, round(l_discount, 2) AS threshold FROM lineitem")
def b4(spark: SparkSession, sf: str) -> DataFrame:
    t = N.threshold_tag(F.col("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", t.alias("tag"), N.tag_threshold(t).alias("threshold"))


@register("b5_first_integer", "SELECT doc_id, CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS n FROM documents")
def b5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", N.first_integer(F.col("source")).alias("n"))


@register("b7_species", "SELECT p_partkey, CASE WHEN lower(p_brand) = 'brand#1' THEN 'First brand' WHEN lower(p_brand) LIKE '%#2%' THEN NULL ELSE p_brand END AS value, CASE WHEN lower(p_brand) LIKE '%#2%' AND lower(p_brand) <> 'brand#1' THEN 'ambiguous_or_unknown' ELSE 'clean' END AS status FROM part")
def b7(spark: SparkSession, sf: str) -> DataFrame:
    s = N.clean_species(F.concat(F.lit("  "), F.col("p_brand"), F.lit(" ")), {"brand#1": "First brand"}, [], ["#2"])
    return table(spark, sf, "part").select("p_partkey", s["value"].alias("value"), s["status"].alias("status"))


@register("b8_rule_labels", "SELECT doc_id, CASE WHEN lang = 'en' THEN 1 WHEN lang = 'fr' THEN 0 ELSE -1 END::INTEGER AS label FROM documents")
def b8(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("t", "en", 1), ("t", "fr", 0), ("other", "de", 1)], "task string, species string, label int")
    return N.label_from_rules(table(spark, sf, "documents"), rules, "lang", "t", "label").select("doc_id", "label")


@register("b11_image_uid", "SELECT vec_id, 'SV_S' || (label % 4 + 1) || ':crown_' || lpad((vec_id % 1000 + 1)::VARCHAR, 4, '0') AS uid FROM embeddings")
def b11(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("s"), (F.col("label") % 4 + 1).cast("string"), F.lit("_tree_"), (F.col("vec_id") % 1000).cast("string"), F.lit(".tif"))
    return table(spark, sf, "embeddings").select("vec_id", N.image_crown_uid(name, 1).alias("uid"))


@register("j25_label_join", f"WITH {BASE_SQL} SELECT doc_id, quality::INTEGER AS quality, toxic::INTEGER AS toxic FROM b")
def j25(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf).select("doc_id", "quality", "toxic")


@register("j28_label_priority", f"""WITH {BASE_SQL} SELECT doc_id, coalesce(nullif(quality, -1), nullif(rule, -1), nullif(toxic, -1), -1)::INTEGER AS label,
  CASE WHEN quality <> -1 THEN 'quality' WHEN rule <> -1 THEN 'rule' WHEN toxic <> -1 THEN 'toxic' END AS label_source,
  len(list_distinct(list_filter([quality, rule, toxic], lambda x: x <> -1))) > 1 AS conflict FROM b""")
def j28(spark: SparkSession, sf: str) -> DataFrame:
    made = E.priority_label({"quality": F.col("quality"), "rule": F.col("rule"), "toxic": F.col("toxic")})
    return base(spark, sf).select("doc_id", *[c.alias(k) for k, c in made.items()])


@register("j29_agreement", f"""WITH {BASE_SQL} SELECT 'quality' AS a, 'rule' AS b, count(*) FILTER (WHERE quality <> -1 AND rule <> -1) AS n_comparable, count(*) FILTER (WHERE quality <> -1 AND rule <> -1 AND quality = rule) AS n_agree FROM b
UNION ALL SELECT 'quality', 'toxic', count(*) FILTER (WHERE quality <> -1 AND toxic <> -1), count(*) FILTER (WHERE quality <> -1 AND toxic <> -1 AND quality = toxic) FROM b""")
def j29(spark: SparkSession, sf: str) -> DataFrame:
    return E.agreement(base(spark, sf), [("quality", "rule"), ("quality", "toxic")]).drop("agreement")


@register("j27_semi_anti", "SELECT lang, count(*) AS n_unlabelled FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1")
def j27(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n_unlabelled"))


@register("j21_year_merge", "SELECT a.l_suppkey, round(a.q, 9) AS y1996_q, round(b.q, 9) AS y1997_q FROM (SELECT l_suppkey, median(l_quantity) AS q FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1) a JOIN (SELECT l_suppkey, median(l_quantity) AS q FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1) b ON a.l_suppkey = b.l_suppkey")
def j21(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem")
    of = lambda y: N.year_prefixed(x.where(F.year("l_shipdate") == y).groupBy("l_suppkey").agg(F.median("l_quantity").alias("q")), y, ["l_suppkey"])
    return rounded(of(1996).join(of(1997), "l_suppkey"), "y1996_q", "y1997_q")


@register("m4_metrics", f"""WITH {BASE_SQL}, x AS (SELECT source, quality AS t, CASE WHEN lang IN ('en', 'de') THEN 1 ELSE 0 END AS p FROM b WHERE quality <> -1),
k AS (SELECT source, c, count(*) FILTER (WHERE t = c) AS sup, count(*) FILTER (WHERE t = c AND p = c) AS hit, count(*) FILTER (WHERE p = c) AS g FROM x CROSS JOIN (VALUES (0), (1)) v(c) GROUP BY 1, 2)
SELECT source, sum(sup)::BIGINT AS n, round(sum(hit) / sum(sup)::DOUBLE, 9) AS accuracy, round(avg(CASE WHEN sup > 0 THEN hit / sup::DOUBLE END), 9) AS balanced_accuracy, round(avg(2.0 * hit / (sup + g)), 9) AS macro_f1 FROM k WHERE sup + g > 0 GROUP BY 1""")
def m4(spark: SparkSession, sf: str) -> DataFrame:
    x = base(spark, sf).where("quality <> -1").withColumn("p", F.col("lang").isin("en", "de").cast("int"))
    return rounded(E.metrics(x, "quality", "p", ["source"]).drop("kappa"), "accuracy", "balanced_accuracy", "macro_f1")


@register("m4_confusion", f"WITH {BASE_SQL} SELECT quality AS truth, rule AS predicted, count(*) AS n FROM b WHERE quality <> -1 GROUP BY 1, 2")
def m4c(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion(base(spark, sf).where("quality <> -1"), "quality", "rule")


@register("m5_tune_threshold", """WITH t AS (SELECT unnest(range(10, 95, 5)) / 100.0 AS threshold), x AS (SELECT l_discount * 10 AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, (l_orderkey % 5)::INTEGER AS fold FROM lineitem),
e AS (SELECT threshold, fold, (count(*) FILTER (WHERE y = 1 AND s >= threshold) / count(*) FILTER (WHERE y = 1)::DOUBLE + count(*) FILTER (WHERE y = 0 AND s < threshold) / count(*) FILTER (WHERE y = 0)::DOUBLE) / 2 AS b FROM x CROSS JOIN t GROUP BY 1, 2)
SELECT threshold::DOUBLE AS threshold, round(avg(b), 9) AS balanced_accuracy FROM e GROUP BY 1""")
def m5(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_orderkey") % 5).cast("int").alias("fold"))
    return rounded(E.tune_threshold(x, "s", "y"), "balanced_accuracy")


@register("m12_mixed_areas", f"WITH {BASE_SQL} SELECT source, count(*) AS n FROM b WHERE source IN (SELECT source FROM b WHERE toxic <> -1 GROUP BY 1 HAVING count(DISTINCT toxic) >= 2) GROUP BY 1")
def m12(spark: SparkSession, sf: str) -> DataFrame:
    return E.mixed_areas(base(spark, sf), "source", "toxic").groupBy("source").agg(F.count("*").alias("n"))


@register("m11_quality_subset", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT quantile_cont(p_retailprice, 0.25) FROM part)")
def m11(spark: SparkSession, sf: str) -> DataFrame:
    return E.quality_subset(table(spark, sf, "part"), "p_retailprice", 0.25).select("p_partkey")


@register("m1_stratified_split", f"WITH {BASE_SQL} SELECT doc_id, quality::INTEGER AS quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * 0.3) AS is_test FROM b WHERE quality <> -1")
def m1(spark: SparkSession, sf: str) -> DataFrame:
    return E.stratified_split(base(spark, sf).where("quality <> -1"), "doc_id", "quality").select("doc_id", "quality", "is_test")


@register("m2_random_forest")
def m2(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0]
    x = e.where("label is not null").select("vec_id", (F.col("label") < 5).cast("double").alias("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(n)])
    split = E.stratified_split(x, "vec_id", "label")
    model = E.random_forest(split.where("not is_test"), [f"e{i}" for i in range(n)], "label")
    return model.transform(split.where("is_test")).select("vec_id", "label", "prediction")


@register("b12_first_present", "SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END, ''), o_orderpriority) AS v FROM orders")
def b12(spark: SparkSession, sf: str) -> DataFrame:
    first = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", N.first_present(first, F.col("o_orderpriority")).alias("v"))


@register("m5_folds", f"WITH {BASE_SQL} SELECT doc_id, ((row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5)::INTEGER AS fold FROM b WHERE quality <> -1")
def m5f(spark: SparkSession, sf: str) -> DataFrame:
    return E.folds(base(spark, sf).where("quality <> -1"), "doc_id", "quality").select("doc_id", "fold")
