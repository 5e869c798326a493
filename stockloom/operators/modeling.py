"""Per-cell forecast models with Spark ML."""

from __future__ import annotations

import datetime as dt
import random
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockloom.functions.clean import feature_columns, keep_finite
from stockloom.operators.features import CLASS_CODES, CLUSTER_CODES
from stockloom.operators.metrics import auc, classification_metrics, regression_metrics

MISSING = -999.0
TWO_STAGE_CELLS = (5, 8)
# Columns that are never model inputs.
DROPPED = {
    "identifiers": ["outlet_id", "item_code", "year_month"],
    "geo_admin": ["territory_id", "region", "district", "province"],
    "product_admin": ["product_category", "product_line", "brand"],
    "segment_strings": ["cluster_definition", "demand_class"],
    "target_leakage": ["target_qty_raw", "target_qty_log1p", "target_is_nonzero", "target_log1p_net_sales"],
}
# Search space. Penalty weights of the original boosters have no counterpart here.
SEARCH_SPACE = {
    "maxIter": [100, 200, 300, 500],
    "maxDepth": [3, 4, 5, 6, 7],
    "stepSize": [0.01, 0.05, 0.1, 0.2],
    "subsamplingRate": [0.6, 0.8, 1.0],
    "featureSubsetStrategy": ["0.6", "0.8", "1.0"],
    "minInstancesPerNode": [1, 3, 5],
}


@dataclass
class Settings:
    train_end: str = "2018-12"
    eval_start: str = "2019-01"
    n_iter: int = 100
    folds: int = 3
    seed: int = 42
    threshold: float = 0.5
    space: dict = field(default_factory=lambda: dict(SEARCH_SPACE))
    #: Fits of the search that run side by side.
    at_once: int = 4


def grid_cells() -> list[tuple[int, str, str, bool]]:
    """(cell, segment, demand class, two-stage?) of the nine cells."""
    return [
        (c * 3 + k, cluster, name, c * 3 + k in TWO_STAGE_CELLS)
        for cluster, c in CLUSTER_CODES.items() for name, k in CLASS_CODES.items()
    ]


def load_cell(matrix: DataFrame, cluster: str, demand_class: str) -> DataFrame:
    """Rows of one cell with both regression targets present."""
    rows = matrix.where((F.col("cluster_definition") == cluster) & (F.col("demand_class") == demand_class))
    return rows.dropna(subset=["target_qty_log1p", "target_qty_raw"])


def time_split(df: DataFrame, train_end: str, eval_start: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("year_month") <= train_end), df.where(F.col("year_month") >= eval_start)


def model_inputs(df: DataFrame, target: str) -> list[str]:
    return feature_columns(df.columns, target, DROPPED)


def fill_missing(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Sentinel for NULL plus one ``<feature>_missing`` flag per window feature.

    Window features are NULL in the first months of a series; the trees need a value.
    """
    flagged = [c for c in features if c.startswith(("lag_", "roll_std", "roll_cv", "yoy", "trend", "months_since"))]
    flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in flagged}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in features}
    return df.withColumns({**flags, **filled}), [*features, *flags]


def month_folds(months: list[str], n: int) -> list[tuple[str, str, str]]:
    """(last training month, first, last test month) of expanding folds in time order."""
    size = len(months) // (n + 1)
    if size == 0:
        raise ValueError(f"{len(months)} months are too few for {n} folds")
    starts = range(len(months) - n * size, len(months), size)
    return [(months[s - 1], months[s], months[s + size - 1]) for s in starts]


def sample_settings(space: dict, n: int, seed: int) -> list[dict]:
    """``n`` different random settings (all of them if the space is smaller)."""
    rng = random.Random(seed)
    total = 1
    for values in space.values():
        total *= len(values)
    picks = rng.sample(range(total), min(n, total))
    settings = []
    for p in picks:
        one = {}
        for name, values in space.items():
            p, at = divmod(p, len(values))
            one[name] = values[at]
        settings.append(one)
    return settings


def regressor(features: list[str], target: str, params: dict, seed: int) -> Pipeline:
    trees = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="prediction", seed=seed, **params)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees])


def classifier(features: list[str], target: str, params: dict, seed: int) -> Pipeline:
    trees = GBTClassifier(featuresCol="features", labelCol=target, weightCol="_weight", seed=seed, **params)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees])


def positive_weight(df: DataFrame, target: str) -> float:
    """Negatives per positive; 1 without positives."""
    row = df.agg(F.count_if(F.col(target) == 0).alias("neg"), F.count_if(F.col(target) == 1).alias("pos")).first()
    return row["neg"] / row["pos"] if row["pos"] else 1.0


def search(df: DataFrame, build, score, settings: Settings) -> tuple[PipelineModel, dict, float]:
    """Random search over expanding month folds, then a refit on all rows.

    ``build(params)`` gives an estimator, ``score(scored frame)`` a number to
    maximise. ``settings.at_once`` fits run side by side, in scheduler pools of their own
    (fair where ``spark.scheduler.mode`` is FAIR); their order does not change the
    result. Only month names and fold scores reach the driver.
    """
    months = [r[0] for r in df.select("year_month").distinct().orderBy("year_month").collect()]  # one row per month
    folds = month_folds(months, settings.folds)
    candidates = sample_settings(settings.space, settings.n_iter, settings.seed)

    def one(task: tuple[int, dict, tuple[str, str, str]]) -> float | None:
        at, params, (last, first, end) = task
        df.sparkSession.sparkContext.setLocalProperty("spark.scheduler.pool", f"search-{at % settings.at_once}")
        model = build(params).fit(df.where(F.col("year_month") <= last))
        return score(model.transform(df.where(F.col("year_month").between(first, end))))

    tasks = [(at, params, fold) for at, params in enumerate(candidates) for fold in folds]
    with ThreadPoolExecutor(settings.at_once) as pool:
        done = list(pool.map(inheritable_thread_target(df.sparkSession)(one), tasks))
    best, best_score = None, None
    for at, params in enumerate(candidates):
        scores = done[at * len(folds):(at + 1) * len(folds)]
        scores = [s for s in scores if s is not None]  # a fold without a row to score says nothing
        if not scores:
            raise ValueError("no fold has a row to score")
        mean = sum(scores) / len(scores)
        if best_score is None or mean > best_score:
            best, best_score = params, mean
    return build(best).fit(df), best, best_score


def _negative_mae(target: str):
    return lambda scored: scored.agg(-F.avg(F.abs(F.col("prediction") - F.col(target)))).first()[0]


def _f1(target: str):
    return lambda scored: classification_metrics(scored, target, "prediction").first()["f1"]


def train_regressor(train: DataFrame, features: list[str], settings: Settings, target: str = "target_qty_log1p"):
    """(model, parameters, fold score) of the log-target regressor."""
    rows = keep_finite(train, [target]).withColumn(target, F.col(target).cast("double")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return search(rows, lambda p: regressor(features, target, p, settings.seed), _negative_mae(target), settings)
    finally:
        rows.unpersist()


def train_classifier(train: DataFrame, features: list[str], settings: Settings, target: str = "target_is_nonzero"):
    """(model, parameters, fold score); positives weigh negatives / positives."""
    weight = positive_weight(train, target)
    rows = train.where(F.col(target).isNotNull()).withColumns({
        target: F.col(target).cast("double"), "_weight": F.when(F.col(target) == 1, weight).otherwise(1.0),
    }).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return search(rows, lambda p: classifier(features, target, p, settings.seed), _f1(target), settings)
    finally:
        rows.unpersist()


def train_two_stage(train: DataFrame, features: list[str], settings: Settings):
    """Classifier on all rows, log regressor on the rows with demand."""
    stage1 = train_classifier(train, features, settings)
    stage2 = train_regressor(train.where(F.col("target_is_nonzero") == 1), features, settings)
    return stage1, stage2


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``predicted_qty`` on the raw scale."""
    out = model.transform(df)
    return out.withColumn("predicted_qty", F.expm1("prediction")).withColumnRenamed("prediction", "predicted_log").drop("features")


def event_probability(scored: DataFrame) -> Column:
    return vector_to_array(F.col("probability"))[1]


def predict_two_stage(clf: PipelineModel, reg: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """0 below the event threshold, else the back-transformed regression."""
    scored = clf.transform(df)
    flagged = scored.withColumn("event_probability", event_probability(scored)).drop(
        "features", "rawPrediction", "probability", "prediction")
    out = reg.transform(flagged)
    value = F.when(F.col("event_probability") >= threshold, F.expm1("prediction")).otherwise(0.0)
    return out.withColumn("predicted_qty", value).drop("features", "prediction")


def evaluate_regression(scored: DataFrame) -> DataFrame:
    """Errors of quantities on the raw scale; MAE and RMSE on the log scale where available."""
    raw = regression_metrics(scored, "target_qty_raw", "predicted_qty")
    if "predicted_log" not in scored.columns:
        return raw
    log = regression_metrics(scored, "target_qty_log1p", "predicted_log").select("mae", "rmse")
    return raw.drop("mae", "rmse").crossJoin(log)


def evaluate_classifier(scored: DataFrame, label: str = "target_is_nonzero", threshold: float = 0.5) -> DataFrame:
    rows = scored.select(label, event_probability(scored).alias("_p")) if "probability" in scored.columns else scored.select(
        label, F.col("event_probability").alias("_p"))
    return classification_metrics(rows, label, "_p", threshold).crossJoin(auc(rows, label, "_p"))


def train_cell(matrix: DataFrame, cell: tuple[int, str, str, bool], settings: Settings) -> dict | None:
    """Load, split, train and score one cell; None for a cell without training rows."""
    number, cluster, name, two_stage = cell
    rows = load_cell(matrix, cluster, name)
    filled, inputs = fill_missing(rows, [
        c for c in model_inputs(rows, "target_qty_log1p") if c in numeric_inputs(rows)])
    train, held = time_split(filled, settings.train_end, settings.eval_start)
    if train.limit(1).count() == 0:
        return None
    if two_stage:
        (clf, p1, s1), (reg, p2, s2) = train_two_stage(train, inputs, settings)
        scored = predict_two_stage(clf, reg, held, settings.threshold)
        return {"cell": number, "models": {"stage1_clf": clf, "stage2_reg": reg}, "params": {"stage1": p1, "stage2": p2},
                "cv_score": s2, "scored": scored, "fitted": predict_two_stage(clf, reg, train, settings.threshold), "cluster": cluster, "demand_class": name}
    reg, params, score = train_regressor(train, inputs, settings)
    return {"cell": number, "models": {"reg": reg}, "params": {"reg": params}, "cv_score": score,
            "scored": predict(reg, held), "fitted": predict(reg, train), "cluster": cluster, "demand_class": name}


def cell_metrics(done: dict, threshold: float = 0.5) -> dict[str, float | None]:
    """Metrics of a cell of :func:`train_cell`: eval_*, train_wmape and train_mape, and of its first stage F1 and AUC.

    Training rows are scored by the same models, so that a wide gap shows overfitting.
    """
    held = evaluate_regression(done["scored"]).first().asDict()
    fitted = regression_metrics(done["fitted"], "target_qty_raw", "predicted_qty").first()
    out = {f"eval_{k}": v for k, v in held.items()} | {"train_wmape": fitted["wmape"], "train_mape": fitted["mape"]}
    if "event_probability" in done["scored"].columns:
        first = evaluate_classifier(done["scored"], threshold=threshold).first()
        out |= {"stage1_eval_f1": first["f1"], "stage1_eval_auc": first["auc"]}
    return out


def numeric_inputs(df: DataFrame) -> set[str]:
    return {n for n, t in df.dtypes if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")}


def save_model(model: PipelineModel, folder: str, name: str) -> str:
    path = f"{folder}/{name}"
    model.write().overwrite().save(path)
    return path


def load_model(folder: str, name: str) -> PipelineModel:
    return PipelineModel.load(f"{folder}/{name}")


def log_run(spark: SparkSession, path: str, model_name: str, params: dict, metrics: dict) -> str:
    """Append one run to the run table (run_id, model_name, logged_at, kind, key, value)."""
    run = uuid.uuid4().hex
    now = dt.datetime.now(dt.timezone.utc).isoformat()
    rows = [(run, model_name, now, kind, k, str(v)) for kind, d in (("param", params), ("metric", metrics)) for k, v in d.items()]
    spark.createDataFrame(rows, "run_id string, model_name string, logged_at string, kind string, key string, value string").write.mode("append").parquet(path)
    return run
