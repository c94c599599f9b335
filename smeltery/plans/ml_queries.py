"""Model queries. Fitted models have no SQL to equal; the parts that do carry it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from smeltery.operators import density, ml, workload
from smeltery.plans.registry import query, sql_table
from smeltery.session import durable, shared_dir


@query(
    "anomaly_labels",
    """SELECT log_id, CASE WHEN mean_exec_time_ms > 5000 THEN 'Execution time spike' WHEN mean_exec_time_ms < 1 AND calls > 1000 THEN 'Unusual query pattern' ELSE 'Performance anomaly' END AS reason FROM query_logs""",
)
def _labels(t):
    return ml.anomaly_labels(t("query_logs"))


@query(
    "time_model_features",
    """SELECT log_id, COALESCE(CASE WHEN json_valid(extracted_features) THEN CAST(json_extract_string(extracted_features, '$.table_count') AS DOUBLE) END, 0) AS table_count,
       COALESCE(CASE WHEN json_valid(extracted_features) THEN CAST(CAST(json_extract_string(extracted_features, '$.has_cte') AS BOOLEAN) AS DOUBLE) END, 0) AS has_cte, calls::DOUBLE AS calls, mean_exec_time_ms::DOUBLE AS target FROM query_logs""",
)
def _time_features(t):
    return ml.time_features(t("query_logs")).select("log_id", "table_count", "has_cte", "calls", "target")


# One point per statement and day: calls by hundreds and rows of the log. Whole numbers, so distances are exact.
sql_table(
    "statement_days",
    """SELECT query_hash || '|' || CAST(collected_at AS DATE)::VARCHAR AS id, (SUM(calls) // 10)::DOUBLE AS x, (COUNT(*) * 20)::DOUBLE AS y FROM query_logs GROUP BY query_hash, CAST(collected_at AS DATE)""",
)


@query(
    "statement_day_clusters",
    """WITH RECURSIVE n AS (SELECT a.id, b.id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM statement_days a JOIN statement_days b ON a.x BETWEEN b.x - 8 AND b.x + 8 AND a.y BETWEEN b.y - 8 AND b.y + 8),
       c AS (SELECT id FROM n WHERE d2 <= 64 GROUP BY id HAVING COUNT(*) >= 6),
       e AS (SELECT n.id AS a, n.other AS b FROM n WHERE d2 <= 64 AND n.id IN (SELECT id FROM c) AND n.other IN (SELECT id FROM c)),
       r AS (SELECT id, id AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
       l AS (SELECT id, MIN(root) AS root FROM r GROUP BY id),
       k AS (SELECT root, ROW_NUMBER() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM l)),
       b AS (SELECT n.id, ARG_MIN(l.root, (d2, l.root)) AS root FROM n JOIN l ON l.id = n.other WHERE d2 <= 64 AND n.id NOT IN (SELECT id FROM c) GROUP BY n.id)
       SELECT s.id, COALESCE(k.cluster, -1)::INTEGER AS cluster, l.id IS NOT NULL AS is_core FROM statement_days s LEFT JOIN l ON l.id = s.id LEFT JOIN b ON b.id = s.id LEFT JOIN k ON k.root = COALESCE(l.root, b.root)""",
)
def _statement_days(t):
    day = F.to_date("collected_at")
    points = t("query_logs").groupBy("query_hash", day.alias("day")).agg(
        F.expr("CAST(SUM(calls) DIV 10 AS DOUBLE)").alias("x"), (F.count("*") * 20).cast("double").alias("y")
    )
    points = points.select(F.concat_ws("|", "query_hash", F.col("day").cast("string")).alias("id"), "x", "y")
    return density.dbscan(points, ["x", "y"], 8.0, 6)


@query("query_time_scorecard")
def _time(t):
    train, test = ml.split_by_key(ml.spread(ml.time_features(t("query_logs"))))
    model = ml.fit_query_time(train, "gbt")
    return ml.regression_scorecard(ml.score_query_time(model, test))


@query("query_time_importance")
def _importance(t):
    model = ml.fit_query_time(ml.spread(ml.time_features(t("query_logs"))), "random_forest")
    return ml.feature_importance(model, t.spark)


@query("query_time_contributions")
def _contributions(t):
    """Mean contribution of every input and its mean size, over all rows."""
    features = ml.spread(ml.time_features(t("query_logs")))
    model = ml.fit_query_time(features, "random_forest", trees=20)
    parts = ml.contributions(model, features, f"{shared_dir(t.spark)}/models/{uuid.uuid4().hex}")
    return parts.groupBy("feature").agg(F.avg("contribution").alias("mean_ms"), F.avg(F.abs("contribution")).alias("mean_size_ms"), F.count("*").alias("rows"))


@query("workload_cluster_profiles")
def _profiles(t):
    features = ml.spread(ml.cluster_features(t("query_logs")))
    return ml.cluster_profiles(ml.assign_clusters(ml.fit_clusters(features), features))


@query("workload_cluster_examples")
def _examples(t):
    features = ml.spread(ml.cluster_features(t("query_logs")))
    return ml.cluster_examples(ml.assign_clusters(ml.fit_clusters(features), features))


@query("workload_cluster_scorecard")
def _cluster_scorecard(t):
    features = ml.spread(ml.cluster_features(t("query_logs")))
    model = ml.fit_clusters(features)
    assigned = ml.assign_clusters(model, features)
    return ml.cluster_scorecard(assigned, model).withColumn("silhouette", F.lit(ml.silhouette(assigned)))


def _flagged(t):
    features = ml.spread(ml.anomaly_features(t("query_logs")))
    return ml.flag_anomalies(ml.score_isolation_forest(ml.fit_isolation_forest(features), features))


@query("isolation_forest_scores")
def _scores(t):
    return _flagged(t)


@query("model_anomalies")
def _anomalies(t):
    return ml.model_anomalies(t("query_logs"), _flagged(t))


@query("anomaly_scorecard")
def _anomaly_scorecard(t):
    return ml.anomaly_scorecard(t("query_logs"), _flagged(t))


@query("anomaly_baseline")
def _baseline(t):
    return ml.baseline_stats(ml.anomaly_features(t("query_logs")), _flagged(t))


@query(
    "model_invariants",
    """SELECT c.check_name, CASE WHEN c.counted THEN n ELSE 1 END::DOUBLE AS value FROM (SELECT COUNT(*) AS n FROM query_logs),
       (VALUES ('cluster sizes', TRUE), ('rows at their nearest centre', TRUE), ('forest rows', TRUE), ('forest scores from -1 to 0', TRUE), ('contributions add up', TRUE), ('importance sum', FALSE)) c(check_name, counted)""",
)
def _invariants(t):
    """What must hold of the fitted models whatever they learned: sizes sum to the rows, and so on."""
    features = ml.spread(ml.cluster_features(t("query_logs")))
    model = ml.fit_clusters(features, starts=2)
    assigned = ml.assign_clusters(model, features)
    points = ml.spread(ml.anomaly_features(t("query_logs")))
    scores = ml.score_isolation_forest(ml.fit_isolation_forest(points, trees=20), points)
    timed = ml.spread(ml.time_features(t("query_logs")))
    forest = ml.fit_query_time(timed, "random_forest", trees=20)
    parts = ml.contributions(forest, timed, f"{shared_dir(t.spark)}/models/{uuid.uuid4().hex}")
    sums = parts.groupBy("log_id").agg((F.first("bias") + F.sum("contribution") - F.first("predicted_ms")).alias("gap"))
    held = durable(scores.agg(F.count("*").alias("n"), F.count_if(F.col("anomaly_score").between(-1.0, 0.0)).alias("inside")))
    figures = {
        "cluster sizes": ml.cluster_profiles(assigned).agg(F.sum("size").alias("v")),
        "rows at their nearest centre": ml.nearest_centre(assigned, model).select(F.col("nearest").alias("v")),
        "forest rows": held.select(F.col("n").alias("v")),
        "forest scores from -1 to 0": held.select(F.col("inside").alias("v")),
        "contributions add up": sums.agg(F.count_if(F.abs("gap") < 1e-6).alias("v")),
        "importance sum": ml.feature_importance(forest, t.spark).agg(F.round(F.sum("importance"), 9).alias("v")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check_name"), F.col("v").cast("double").alias("value")) for name, df in figures.items()])


@query("cache_classifier_candidates")
def _candidates(t):
    return ml.top_cache_candidates(workload.cache_features(t("query_logs")), or_heuristic=True)


@query("cache_classifier_scorecard")
def _cache_scorecard(t):
    training = ml.spread(ml.cache_training(workload.cache_features(t("query_logs"))), "query_text")
    train, test = ml.split_by_key(training, "query_text")
    model = ml.fit_cache_classifier(train)
    if model is None:
        # One class or too few statements: there is no model and so no figure.
        nothing = F.lit(None).cast("double")
        return test.agg(F.count("*").alias("rows")).select("rows", nothing.alias("accuracy"), nothing.alias("auc"))
    return ml.classifier_scorecard(model, test)
