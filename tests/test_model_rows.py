"""Rows walk fitted trees in batches, once, and clusters keep their points as vectors."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from smeltery.operators import ml


def _points(spark, rows=600):
    columns = [((F.col("id") * 37 + i * 11) % (13 + 7 * i)).cast("double").alias(c) for i, c in enumerate(ml.ANOMALY_FEATURES)]
    return ml.anomaly_features(spark.range(rows).select(F.col("id").alias("log_id"), *columns))


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_flags_share_one_scoring(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def scored(x):
        seen.add(1)
        return -float(x % 97) / 97

    scores = spark.range(500).select(F.col("id").alias("log_id"), scored("id").alias("anomaly_score"))
    flagged = ml.flag_anomalies(scores)
    assert flagged.where("is_anomaly").count() >= 50 and flagged.count() == 500
    assert seen.value == 500


def test_forest_scores_equal_a_walk_in_plain_python(spark):
    points = _points(spark)
    forest = ml.fit_isolation_forest(points, trees=7, sample=64)
    scores = ml.score_isolation_forest(forest, points, sample=64)
    assert "lambda" not in _plan(scores)
    trees = [g.set_index("node") for _, g in forest.groupby("tree")]
    norm = float(ml._average_path(np.array([64]))[0])
    values = {r[0]: r[1:] for r in points.collect()}
    for row in scores.collect():
        total = 0.0
        for tree in trees:
            node = tree.loc[0]
            while node["feature"] >= 0:
                side = "left" if values[row.log_id][int(node["feature"])] < node["threshold"] else "right"
                node = tree.loc[int(node[side])]
            total += node["depth"] + float(ml._average_path(np.array([node["size"]]))[0])
        assert abs(row.anomaly_score + 2.0 ** -(total / 7 / norm)) < 1e-12


def test_contributions_walk_in_batches_and_add_up(spark, tmp_path):
    columns = [((F.col("id") * 31 + i * 17) % (5 + 3 * i)).cast("double").alias(c) for i, c in enumerate(ml.TIME_FEATURES)]
    rows = spark.range(800).select(F.col("id").alias("log_id"), *columns).withColumn("target", F.expr("table_count * 3 + calls * join_count"))
    model = ml.fit_query_time(rows, "random_forest", trees=4, depth=3)
    parts = ml.contributions(model, rows, str(tmp_path / "m"), depth=3)
    assert "lambda" not in _plan(parts)
    sums = parts.groupBy("log_id").agg((F.first("bias") + F.sum("contribution") - F.first("predicted_ms")).alias("gap"), F.count("*").alias("n"))
    assert sums.where((F.abs("gap") < 1e-9) & (F.col("n") == len(ml.TIME_FEATURES))).count() == 800


def test_cluster_fits_keep_their_own_vectors(spark, monkeypatch):
    levels, fit = [], KMeans.fit

    def watched(self, points):
        levels.append((points.storageLevel.useMemory, points.columns))
        return fit(self, points)

    monkeypatch.setattr(KMeans, "fit", watched)
    rows = spark.range(300).select(*[(F.col("id") % (3 + i)).cast("double").alias(c) for i, c in enumerate(ml.CLUSTER_FEATURES)], F.lit("text").alias("query_text"))
    ml.fit_clusters(rows, starts=3, k=2)
    assert levels == [(False, ["features"])] * 3
