import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from patchsieve.operators import models as L


def table(spark, n=3000):
    df = spark.range(n).select(
        "id", (F.col("id") * 7 % 13).alias("a"), (F.col("id") * 5 % 11).cast("double").alias("b"), (F.col("id") % 3 == 0).alias("c"))
    return df.withColumn("label", ((F.col("a") > 6) & (F.col("b") < 8) | F.col("c") & (F.col("b") > 3)).cast("double"))


def test_trees_on_bins_equal_trees_on_rows(spark):
    df = table(spark)
    _, rows = L.binned(df, ["a", "b"], "label")
    assert rows.count() <= 13 * 11 * 2 and rows.agg(F.sum("__weight")).first()[0] == pytest.approx(
        L.weighted(df, "label", False).agg(F.sum("__weight")).first()[0])
    settings = {"maxIter": 4, "maxDepth": 3, "stepSize": 0.1}
    got = L.probability(L.fit_boosted_trees(df, ["a", "b"], "label", **settings), df)
    assert got.columns == [*df.columns, "score"] and got.count() == df.count()
    plain = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="__raw"), GBTClassifier(
        featuresCol="__raw", labelCol="label", weightCol="__weight", seed=42, **settings)]).fit(L.weighted(df, "label", False))
    want = L.probability(plain, df).select("id", F.col("score").alias("want"))
    worst = got.join(want, "id").agg(F.max(F.abs(F.col("score") - F.col("want")))).first()[0]
    assert worst < 1e-9


def test_all_pairs_of_a_large_change_are_fitted(spark):
    df = spark.range(2100).select(
        F.lit(1).alias("c"), F.col("id").alias("f"), F.lit(True).alias("identity"), (F.col("id") * 3 % 17).alias("a"),
        F.when(F.col("id") < 1100, "FILE_STRONG").otherwise("FILE_WEAK").alias("level"))
    gaps = L.pair_gaps(df, ["c"], ["f"], ["a"])
    assert gaps.count() == 1100 * 1000
    rows = df.collect()
    want = sum(r.a for r in rows[:1100]) * 1000 - sum(r.a for r in rows[1100:]) * 1100
    assert gaps.agg(F.sum(F.col("gap")[0])).first()[0] == want


def test_rows_are_not_dealt_by_split(spark, capsys):
    df = table(spark).withColumn("split", F.when(F.col("id") % 10 < 7, "train").otherwise("test"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        L.pu_ranker(df.where("split = 'train'"), df, ["a", "b"], "label", ["split"]).explain("formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in capsys.readouterr().out


def test_a_tree_fit_has_few_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, rows = L.binned(table(spark), ["a", "b"], "label")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows.rdd.getNumPartitions() == 1


def test_fits_read_rows_that_are_joined_once(spark, capsys):
    from patchsieve.plans.models import FEATURES, fit_rows
    from patchsieve.plans.registry import Tables

    rows = fit_rows(Tables(spark, "/root/testdata/sf0.001"))
    rows.explain()
    assert rows.columns == ["split", "label", *FEATURES] and "Join" not in capsys.readouterr().out


def test_a_report_reads_rows_and_scores_where_they_were_written(spark):
    """The joins of the rows and the scores of the model are made once, not for every metric."""
    from patchsieve.plans.models import train_report
    from patchsieve.plans.registry import Tables

    out = train_report(Tables(spark, "/root/testdata/sf0.001"))
    read = out.inputFiles()
    assert read and not any(f.endswith(("lineitem.parquet", "orders.parquet", "customer.parquet")) for f in read)
    assert {"train", "validation", "test"} == {r["split"] for r in out.select("split").distinct().collect()}
