"""Models over the query log, fitted and applied on DataFrames."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from smeltery.functions.exprs import ratio, stable_id
from smeltery.functions.ordered import order_statistics
from smeltery.operators.workload import cache_heuristic, read_features
from smeltery.session import durable

# Feature names and model settings.
TIME_FEATURES = (
    "table_count",
    "join_count",
    "has_aggregation",
    "has_window_function",
    "has_subquery",
    "has_cte",
    "filter_predicate_count",
    "order_by_count",
    "group_by_count",
    "estimated_rows_log",
    "estimated_cost_log",
    "plan_depth",
    "calls",
)
CLUSTER_FEATURES = ("mean_exec_time_ms", "estimated_rows", "table_count", "join_count", "filter_predicate_count")
ANOMALY_FEATURES = ("mean_exec_time_ms", "calls", "rows_affected", "shared_blks_hit", "shared_blks_read")
SEED = 42
CLUSTERS = 5
TREES = 100
DEPTH = 6
STARTS = 10
TREE_SAMPLE = 256
CONTAMINATION = 0.1
CACHE_MIN_CALLS = 10
CACHE_MIN_MS = 100.0
CACHE_MIN_GROUPS = 20
CACHE_THRESHOLD = 0.7


# Features ---------------------------------------------------------------------------------


def time_features(logs: DataFrame) -> DataFrame:
    """The thirteen inputs of the time model and its target."""
    f = read_features(logs)
    rows = f.withColumns(
        {
            "estimated_rows_log": F.log1p("estimated_rows"),
            "estimated_cost_log": F.log1p("estimated_cost"),
            "target": F.coalesce(F.col("mean_exec_time_ms").cast("double"), F.lit(0.0)),
        }
    )
    return rows.select(
        "log_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in TIME_FEATURES], "target"
    )


def cluster_features(logs: DataFrame) -> DataFrame:
    f = read_features(logs)
    return f.select(
        "log_id",
        "query_text",
        "calls",
        "has_aggregation",
        "has_window_function",
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in CLUSTER_FEATURES],
    )


def split_by_key(df: DataFrame, key: str = "log_id", test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key, the same in every run and on every executor."""
    bucket = F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(1000))
    cut = int(test_share * 1000)
    return df.where(bucket >= cut), df.where(bucket < cut)


def spread(features: DataFrame, key: str = "log_id") -> DataFrame:
    """Feature rows spread over the executors and stored for the passes of a fit.

    Features are narrow; one shuffle of them is paid once, the scan and the parsing behind
    them are not repeated per pass. The checkpoint goes when the frame is no longer referred to.
    """
    return durable(features.repartition(F.col(key)))


def _scaled(inputs: Sequence[str], *, center: bool = False) -> list:
    return [
        VectorAssembler(inputCols=list(inputs), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=center, withStd=True),
    ]


# Query time -------------------------------------------------------------------------------


def _regressor(kind: str, trees: int, depth: int):
    if kind == "random_forest":
        return RandomForestRegressor(labelCol="target", numTrees=trees, maxDepth=depth, seed=SEED)
    if kind in ("gbt", "gradient_boosting", "xgboost"):
        return GBTRegressor(labelCol="target", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=SEED)
    raise ValueError(f"unknown model kind {kind}")


def fit_query_time(features: DataFrame, kind: str = "gbt", trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """Boosted trees or a random forest on the scaled features."""
    return Pipeline(stages=[*_scaled(TIME_FEATURES), _regressor(kind, trees, depth)]).fit(features)


def score_query_time(model: PipelineModel, features: DataFrame) -> DataFrame:
    return model.transform(features).select("log_id", "target", F.col("prediction").alias("predicted_ms"))


def regression_scorecard(predictions: DataFrame, label: str = "target", value: str = "predicted_ms") -> DataFrame:
    """RMSE, MAE, R2, mean and median absolute relative error, in one pass and one rank lookup."""
    error = F.col(value) - F.col(label)
    relative = F.when(F.col(label) != 0, F.abs(error) / F.abs(F.col(label)))
    rows = predictions.select(
        F.lit(1).alias("_all"),
        F.col(label).alias("y"),
        error.alias("e"),
        F.round(relative, 6).alias("r"),
    )
    sums = rows.agg(
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        F.avg(F.abs("e")).alias("mae"),
        (1 - ratio(F.avg(F.col("e") * F.col("e")), F.var_pop("y"))).alias("r2"),
        (F.avg("r") * 100).alias("mape_pct"),
        F.count("*").alias("rows"),
    )
    median = order_statistics(rows, ["_all"], "r", {"k": F.floor(F.col("n") / 2)}, 6).select("k").scalar()
    return sums.withColumn("median_ape_pct", median * 100)


def cross_validate(features: DataFrame, kind: str = "gbt", trees: int = TREES, depth: int = DEPTH, folds: int = 5) -> float:
    """Mean RMSE over the folds."""
    pipeline = Pipeline(stages=[*_scaled(TIME_FEATURES), _regressor(kind, trees, depth)])
    checker = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=RegressionEvaluator(labelCol="target", metricName="rmse"),
        numFolds=folds,
        seed=SEED,
    )
    return checker.fit(features).avgMetrics[0]


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(TIME_FEATURES, weights)]
    return spark.createDataFrame(rows, "feature string, importance double")


def tree_arrays(model: PipelineModel, path: str) -> DataFrame:
    """One row with the trees of a fitted ensemble, each as arrays of its nodes in saved order; ``path`` takes the saved model."""
    trees = model.stages[-1]
    trees.write().overwrite().save(path)
    shares = list(trees.treeWeights)
    if isinstance(trees, RandomForestRegressionModel):
        shares = [w / sum(shares) for w in shares]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in shares]), F.col("treeID") + 1)
    node = SparkSession.getActiveSession().read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("node"),
        F.when(F.col("nodeData.leftChild") >= 0, F.col("nodeData.split.featureIndex")).otherwise(-1).alias("feature"),
        F.get(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
        F.col("nodeData.leftChild").alias("lo"),
        F.col("nodeData.rightChild").alias("hi"),
        (F.col("nodeData.prediction") * weight).alias("value"),
    )
    lists = node.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("node", "feature", "threshold", "lo", "hi", "value"))).alias("n"))
    arrays = F.struct(*[F.col(f"n.{c}").alias(c) for c in ("feature", "threshold", "lo", "hi", "value")])
    return lists.agg(F.collect_list(arrays).alias("trees"))


def _children(number: np.ndarray, leaf: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Where a row goes from node i: entry 2 i + 1 to the left, 2 i to the right; a leaf keeps it."""
    return np.stack([np.where(leaf, number, right), np.where(leaf, number, left)], axis=1).ravel()


def contributions(model: PipelineModel, features: DataFrame, path: str, depth: int = DEPTH) -> DataFrame:
    """log_id, feature, contribution, bias, predicted_ms: what each input adds to a prediction along the paths of its trees.

    A step from a node to its child adds the change of the node value to the feature that was asked; the bias is the sum
    of the root values. Bias and contributions add up to the prediction. The rows of an Arrow batch walk a tree together.
    """
    trees = tree_arrays(model, path).first()["trees"]  # bounded by the fit, goes with the tasks
    sizes = np.array([len(tree["feature"]) for tree in trees])
    roots = np.cumsum(sizes) - sizes

    def joined(field: str, kind: type) -> np.ndarray:
        return np.array([v for tree in trees for v in tree[field]], dtype=kind)

    number, start = np.arange(sizes.sum()), np.repeat(roots, sizes)
    asked = joined("feature", int)
    leaf, feature = asked < 0, np.maximum(asked, 0)
    threshold, value = joined("threshold", float), joined("value", float)
    children = _children(number, leaf, start + joined("lo", int), start + joined("hi", int))

    @F.pandas_udf("array<double>")
    def added(vectors: pd.Series) -> pd.Series:
        values = np.vstack(vectors.to_numpy()).T.copy()
        rows = np.arange(values.shape[1])
        found = np.zeros(values.shape)
        for root in roots:
            at = np.full(len(rows), root)
            for _ in range(depth):
                following = children[2 * at + (values[feature[at], rows] <= threshold[at])]
                found[feature[at], rows] += value[following] - value[at]
                at = following
        return pd.Series(list(found.T))

    scored = model.transform(features).select("log_id", vector_to_array("features").alias("x"), F.col("prediction").alias("predicted_ms"))
    bias = F.lit(float(sum(value[roots].tolist(), 0.0)))
    listed = scored.select("log_id", "predicted_ms", bias.alias("bias"), added("x").alias("d"))
    rows = F.array(*[F.struct(F.lit(name).alias("feature"), F.get("d", F.lit(i)).alias("contribution")) for i, name in enumerate(TIME_FEATURES)])
    return listed.select("log_id", "predicted_ms", "bias", F.inline(rows)).select("log_id", "feature", "contribution", "bias", "predicted_ms")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# Clusters ---------------------------------------------------------------------------------


def fit_clusters(
    features: DataFrame, inputs: Sequence[str] = CLUSTER_FEATURES, k: int = CLUSTERS, starts: int = STARTS, components: int | None = None
) -> PipelineModel:
    """KMeans on standardised features, the best of ``starts`` starts; ``components`` reduces the inputs first."""
    stages = _scaled(inputs, center=True)
    column = "features"
    if components is not None:
        stages.append(PCA(k=components, inputCol="features", outputCol="components"))
        column = "components"
    prepared = Pipeline(stages=stages).fit(features)
    # Stored narrow and not cached as a table: a fit keeps its points as vectors then, and does not decode them per pass.
    points = durable(prepared.transform(features).select(column))

    def fit(start: int):
        return KMeans(k=k, seed=SEED + start, maxIter=300, featuresCol=column, predictionCol="cluster").fit(points)

    # The starts are jobs of their own over the same stored points; two at a time, as each holds its vectors in memory.
    with ThreadPool(min(starts, 2)) as pool:
        fits = pool.map(inheritable_thread_target(features.sparkSession)(fit), range(starts), chunksize=1)
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return PipelineModel([*prepared.stages, best])


def assign_clusters(model: PipelineModel, features: DataFrame) -> DataFrame:
    return model.transform(features)


def cluster_profiles(assigned: DataFrame) -> DataFrame:
    """Size and means per cluster; noise (-1) has no profile."""
    return assigned.where("cluster <> -1").groupBy("cluster").agg(
        F.count("*").alias("size"),
        F.avg("mean_exec_time_ms").alias("avg_execution_time_ms"),
        F.avg("table_count").alias("avg_table_count"),
        F.avg("join_count").alias("avg_join_count"),
        F.avg("has_aggregation").alias("has_aggregation_ratio"),
        F.avg("has_window_function").alias("has_window_function_ratio"),
    )


def cluster_examples(assigned: DataFrame, per_cluster: int = 25) -> DataFrame:
    """Most called texts of every cluster."""
    sums = (
        assigned.where(F.trim(F.coalesce("query_text", F.lit(""))) != "")
        .groupBy("cluster", "query_text")
        .agg(
            F.count("*").alias("sample_count"),
            F.sum("calls").alias("calls_sum"),
            F.avg("mean_exec_time_ms").alias("mean_exec_ms"),
        )
    )
    order = W.partitionBy("cluster").orderBy(F.col("calls_sum").desc(), F.col("sample_count").desc(), "query_text")
    top = sums.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= per_cluster)
    preview = F.regexp_replace(F.trim("query_text"), r"\s+", " ")
    return top.select("cluster", preview.alias("query_preview"), "calls_sum", "mean_exec_ms", "sample_count")


def nearest_centre(assigned: DataFrame, model: PipelineModel) -> DataFrame:
    """Rows whose cluster is the one of the nearest printed centre, and all rows; equal where the assignment holds."""
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.stages[-1].clusterCenters()])
    held = assigned.select("cluster", vector_to_array("features").alias("v"))
    squares = F.transform(centres, lambda c: F.aggregate(F.zip_with("v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    gap = F.get(F.col("d"), F.col("cluster")) - F.array_min("d")
    return held.select("cluster", squares.alias("d")).agg(F.count_if(gap <= 1e-9).alias("nearest"), F.count("*").alias("rows"))


def silhouette(assigned: DataFrame) -> float:
    return ClusteringEvaluator(predictionCol="cluster", featuresCol="features").evaluate(assigned)


def cluster_scorecard(assigned: DataFrame, model: PipelineModel) -> DataFrame:
    """Inertia, Calinski-Harabasz and Davies-Bouldin from sums per cluster."""
    centers = model.stages[-1].clusterCenters()
    dims = len(centers[0])
    held = assigned.select("cluster", vector_to_array("features").alias("v"))
    center = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers]), F.col("cluster") + 1)
    square = F.aggregate(
        F.zip_with("v", center, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x
    )
    per = held.select("cluster", "v", square.alias("d2")).groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum("d2").alias("within"), F.avg(F.sqrt("d2")).alias("spread"), *[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dims)]
    )
    # One row per cluster: small by construction.
    rows = per.collect()
    n, k = sum(r["n"] for r in rows), len(rows)
    means = {r["cluster"]: np.array([r[f"m{i}"] for i in range(dims)]) for r in rows}
    whole = sum(r["n"] * means[r["cluster"]] for r in rows) / n
    within = sum(r["within"] for r in rows)
    between = sum(r["n"] * float(np.sum((means[r["cluster"]] - whole) ** 2)) for r in rows)
    worst = []
    for a in rows:
        pairs = [
            (a["spread"] + b["spread"]) / float(np.linalg.norm(means[a["cluster"]] - means[b["cluster"]]))
            for b in rows
            if b["cluster"] != a["cluster"] and np.any(means[a["cluster"]] != means[b["cluster"]])
        ]
        worst.append(max(pairs) if pairs else 0.0)
    calinski = (between / (k - 1)) / (within / (n - k)) if k > 1 and within and n > k else float("nan")
    return assigned.sparkSession.createDataFrame(
        [(k, n, float(within), float(calinski), float(sum(worst) / k))],
        "clusters int, rows long, inertia double, calinski_harabasz double, davies_bouldin double",
    )


def assign_to_centroids(points: DataFrame, vector: str, centroids: dict[int, Sequence[float]], eps: float) -> DataFrame:
    """Nearest given centroid within ``eps``, else -1. The centroids ride along in the expression."""
    best = F.lit(float("inf"))
    label = F.lit(-1)
    for name, center in sorted(centroids.items()):
        square = F.lit(0.0)
        for i, x in enumerate(center):
            square = square + (F.col(vector)[i] - F.lit(float(x))) * (F.col(vector)[i] - F.lit(float(x)))
        distance = F.sqrt(square)
        label = F.when(distance < best, F.lit(name)).otherwise(label)
        best = F.least(best, distance)
    return points.withColumn("cluster", F.when(best <= eps, label).otherwise(F.lit(-1)))


# Anomalies ----------------------------------------------------------------------------------


def anomaly_features(logs: DataFrame) -> DataFrame:
    """Inputs of the forest; time on a log scale."""
    zero = F.lit(0.0)
    values = {c: F.coalesce(F.col(c).cast("double"), zero) for c in ANOMALY_FEATURES}
    values["mean_exec_time_ms"] = F.log1p(values["mean_exec_time_ms"])
    return logs.select("log_id", *[v.alias(f"x_{c}") for c, v in values.items()])


_X = [f"x_{c}" for c in ANOMALY_FEATURES]
_NODES = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


def _grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One isolation tree from one sample, as node rows."""
    tree = int(key[0])
    values = rows[_X].to_numpy(dtype=float)
    random = np.random.default_rng(SEED + tree)
    limit = math.ceil(math.log2(max(2, len(values))))
    nodes: list[list] = []
    waiting = [(np.arange(len(values)), 0, None, False)]
    while waiting:
        picked, depth, parent, is_right = waiting.pop()
        number = len(nodes)
        nodes.append([tree, number, -1, 0.0, -1, -1, len(picked), depth])
        if parent is not None:
            nodes[parent][5 if is_right else 4] = number
        held = values[picked]
        span = held.max(axis=0) - held.min(axis=0) if len(picked) else np.zeros(len(_X))
        usable = np.flatnonzero(span > 0)
        if depth >= limit or len(picked) <= 1 or len(usable) == 0:
            continue
        feature = int(random.choice(usable))
        cut = float(random.uniform(held[:, feature].min(), held[:, feature].max()))
        goes_left = held[:, feature] < cut
        nodes[number][2:4] = [feature, cut]
        waiting.append((picked[~goes_left], depth + 1, number, True))
        waiting.append((picked[goes_left], depth + 1, number, False))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    n = n.astype(float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def fit_isolation_forest(features: DataFrame, trees: int = TREES, sample: int = TREE_SAMPLE) -> pd.DataFrame:
    """Node table of the forest: at most ``trees`` times twice ``sample`` rows.

    The sample is the rows with the lowest hashes, so it is the same in every run; trees
    grow in parallel, one group of ``sample`` rows each. Hashes are even, so a cut from the
    row count leaves little more than the sample before anything is sorted.
    """
    need = trees * sample
    total = features.agg(F.count("*").alias("n")).first()["n"]
    copies = max(1, math.ceil(need / max(1, total)))
    spread = features.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    hashed = spread.withColumn("_hash", F.xxhash64(F.lit(SEED), "_copy", "log_id"))
    share = min(1.0, (need + 8 * math.sqrt(need)) / max(1, total * copies))
    cut = min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))
    chosen = hashed.where(F.col("_hash") <= cut).orderBy("_hash").limit(need)
    place = F.row_number().over(W.orderBy("_hash")) - 1
    grouped = chosen.withColumn("tree", F.floor(place / sample).cast("int")).groupBy("tree")
    return grouped.applyInPandas(_grow, _NODES).toPandas()


def score_isolation_forest(forest: pd.DataFrame, features: DataFrame, sample: int = TREE_SAMPLE) -> DataFrame:
    """Score per row, lower is stranger: minus two to the power of minus mean depth over expected depth.

    The rows of an Arrow batch walk a tree together, level by level. The forest, bounded by its fit, goes with the tasks.
    """
    forest = forest.sort_values(["tree", "node"])
    number = np.arange(len(forest))
    first = number - forest["node"].to_numpy()
    leaf = forest["feature"].to_numpy() < 0
    feature = np.where(leaf, 0, forest["feature"].to_numpy())
    threshold = forest["threshold"].to_numpy(dtype=float)
    children = _children(number, leaf, first + forest["left"].to_numpy(), first + forest["right"].to_numpy())
    path = forest["depth"].to_numpy(dtype=float) + _average_path(forest["size"].to_numpy())
    roots = number[forest["node"].to_numpy() == 0].tolist()
    levels = int(forest["depth"].max()) if len(forest) else 0

    @F.pandas_udf("double")
    def depths(*columns: pd.Series) -> pd.Series:
        values = np.array([c.to_numpy(dtype=float) for c in columns])
        rows = np.arange(values.shape[1])
        total = np.zeros(len(rows))
        for root in roots:
            at = np.full(len(rows), root)
            for _ in range(levels):
                at = children[2 * at + (values[feature[at], rows] < threshold[at])]
            total += path[at]
        return pd.Series(total)

    norm = float(_average_path(np.array([sample]))[0])
    score = -F.pow(F.lit(2.0), -(F.col("_depth") / F.lit(float(len(roots)))) / F.lit(norm))
    return features.select("log_id", depths(*_X).alias("_depth")).select("log_id", score.alias("anomaly_score"))


def flag_anomalies(scores: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """The strangest share of the rows. Scores are stored: the cut and whatever reads the flags share one scoring."""
    scores = durable(scores)
    cut = scores.agg(F.percentile_approx("anomaly_score", contamination, 10_000)).scalar()
    return scores.withColumn("is_anomaly", F.col("anomaly_score") <= cut)


def baseline_stats(features: DataFrame, flagged: DataFrame) -> DataFrame:
    """Mean and deviation of the normal rows per input."""
    normal = features.join(flagged.where("NOT is_anomaly").select("log_id"), "log_id", "left_semi")
    wide = normal.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in _X])
    return wide.select(
        F.inline(F.array(*[F.struct(F.lit(c[2:]).alias("feature"), F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std")) for c in _X]))
    )


def anomaly_reason(ms: Column, calls: Column) -> Column:
    return (
        F.when(ms > 5000, "Execution time spike")
        .when((ms < 1) & (calls > 1000), "Unusual query pattern")
        .otherwise("Performance anomaly")
    )


def model_anomalies(logs: DataFrame, flagged: DataFrame) -> DataFrame:
    """Anomalous log rows as alerts, graded by reason and strength."""
    rows = logs.join(flagged.where("is_anomaly"), "log_id")
    ms = F.coalesce(F.col("mean_exec_time_ms").cast("double"), F.lit(0.0))
    reason = anomaly_reason(ms, F.coalesce("calls", F.lit(0)))
    strength = F.greatest(F.lit(0.0), -F.col("anomaly_score"))
    severity = (
        F.when((reason == "Execution time spike") | (strength > 1.0), "high").when(strength > 0.3, "medium").otherwise("low")
    )
    upper = F.upper(F.coalesce("query_text", F.lit("")))
    ident = stable_id(upper, F.lit("|"), F.col("collected_at").cast("string"), F.lit("|"), F.col("log_id").cast("string"))
    hint = F.nullif(F.lower(F.regexp_extract(upper, r"\b((?:GOLD|SILVER|BRONZE)\.[A-Z0-9_]+)", 1)), F.lit(""))
    return rows.select(
        F.concat(F.lit("model_anom_"), ident).alias("alert_id"),
        F.lit("model_anomaly").alias("type"),
        severity.alias("severity"),
        F.lit("Model-detected anomaly").alias("title"),
        F.concat(reason, F.lit(" (score="), F.round("anomaly_score", 3).cast("string"), F.lit(")")).alias("message"),
        F.lit(None).cast("string").alias("layer"),
        hint.alias("table_name"),
        F.col("collected_at").alias("occurred_at"),
        F.lit("active").alias("status"),
    )


def anomaly_labels(logs: DataFrame) -> DataFrame:
    """Reason a row would be reported under."""
    ms = F.coalesce(F.col("mean_exec_time_ms").cast("double"), F.lit(0.0))
    return logs.select("log_id", anomaly_reason(ms, F.coalesce("calls", F.lit(0))).alias("reason"))


def anomaly_scorecard(logs: DataFrame, flagged: DataFrame) -> DataFrame:
    """Precision, recall and F1 against rows above the 99th percentile of time."""
    timed = logs.select(
        "log_id", F.lit(1).alias("_all"), F.coalesce("mean_exec_time_ms", F.lit(0)).cast("decimal(18,3)").alias("ms")
    )
    cut = order_statistics(timed, ["_all"], "ms", {"k": F.floor((F.col("n") - 1) * F.lit(0.99))}, 3).select("k").scalar()
    joined = timed.join(flagged, "log_id").select((F.col("ms").cast("double") > cut).alias("y"), "is_anomaly")
    sums = joined.agg(
        F.count_if(F.col("y") & F.col("is_anomaly")).alias("tp"),
        F.count_if(~F.col("y") & F.col("is_anomaly")).alias("fp"),
        F.count_if(F.col("y") & ~F.col("is_anomaly")).alias("fn"),
    )
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(
        "tp",
        "fp",
        "fn",
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
    )


# Cache candidates -----------------------------------------------------------------------------

CACHE_INPUTS = ("c_samples", "c_calls", "c_mean", "c_max", "c_rows", "c_hits")


def cache_training(
    features: DataFrame, min_calls: float = CACHE_MIN_CALLS, min_ms: float = CACHE_MIN_MS
) -> DataFrame:
    """Log-scaled inputs per statement with the weak label: called often and slow enough."""
    low = lambda c: F.log1p(F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0))))
    positive = (F.col("calls_sum") >= min_calls) & (F.col("mean_exec_ms") >= min_ms)
    return features.select(
        "*",
        low("sample_count").alias("c_samples"),
        low("calls_sum").alias("c_calls"),
        low("mean_exec_ms").alias("c_mean"),
        low("max_exec_ms").alias("c_max"),
        low("mean_rows_affected").alias("c_rows"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("mean_hit_ratio"))).alias("c_hits"),
        positive.cast("double").alias("label"),
    )


def fit_cache_classifier(training: DataFrame) -> PipelineModel | None:
    """Random forest; None with too few statements or only one class."""
    seen = training.agg(F.count("*").alias("n"), F.count_distinct("label").alias("classes")).first()
    if seen["n"] < CACHE_MIN_GROUPS or seen["classes"] < 2:
        return None
    forest = RandomForestClassifier(numTrees=50, maxDepth=10, seed=SEED)
    return Pipeline(stages=[*_scaled(CACHE_INPUTS, center=True), forest]).fit(training)


def cache_candidates(
    model: PipelineModel, training: DataFrame, threshold: float = CACHE_THRESHOLD, limit: int | None = None
) -> DataFrame:
    """Statements by their chance of being worth caching."""
    scored = model.transform(training).withColumn("cache_probability", vector_to_array("probability")[1])
    held = scored.where(F.col("cache_probability") >= threshold)
    if limit is not None:
        held = held.orderBy(F.col("cache_probability").desc(), "query_text").limit(limit)
    return held.select(
        F.col("query_text").alias("query_preview"),
        "cache_probability",
        "sample_count",
        "calls_sum",
        "mean_exec_ms",
        "sample_log_id",
    )


def top_cache_candidates(
    features: DataFrame, threshold: float = CACHE_THRESHOLD, limit: int | None = None, or_heuristic: bool = False, **labels: float
) -> DataFrame:
    """Ranked by the classifier. Where none can be fitted (few statements, one class) there are no rows, or with
    ``or_heuristic`` the rule of thumb ranks; ``source`` says which it was."""
    training = spread(cache_training(features, **labels), "query_text")
    model = fit_cache_classifier(training)
    if model is None:
        ranked = cache_heuristic(features, threshold, limit).withColumn("source", F.lit("heuristic"))
        return ranked if or_heuristic else ranked.limit(0)
    return cache_candidates(model, training, threshold, limit).withColumn("source", F.lit("random_forest"))


def classifier_scorecard(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Accuracy and area under the curve."""
    scored = model.transform(rows)
    area = BinaryClassificationEvaluator(labelCol="label").evaluate(scored)
    return scored.agg(
        F.count("*").alias("rows"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")
    ).withColumn("auc", F.lit(float(area)))
