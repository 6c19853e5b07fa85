"""Training, tuning and scoring with Spark ML."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import feature as T
from pyspark.ml import regression as R
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkling.functions.hashing import hash32

MODELS = {
    "linear": lambda: R.LinearRegression(),
    "ridge": lambda: R.LinearRegression(regParam=1.0, elasticNetParam=0.0),
    "lasso": lambda: R.LinearRegression(regParam=0.1, elasticNetParam=1.0),
    "huber": lambda: R.LinearRegression(loss="huber"),
    "tree": lambda: R.DecisionTreeRegressor(seed=0),
    "forest": lambda: R.RandomForestRegressor(seed=0),
    "boosting": lambda: R.GBTRegressor(seed=0),
    "logistic": lambda: C.LogisticRegression(),
    "tree_classifier": lambda: C.DecisionTreeClassifier(seed=0),
    "forest_classifier": lambda: C.RandomForestClassifier(seed=0),
    "boosting_classifier": lambda: C.GBTClassifier(seed=0),
    "svm": lambda: C.LinearSVC(),
}
#: Kinds that predict a class.
CLASSIFIERS = frozenset([*(k for k in MODELS if k.endswith("classifier")), "logistic", "svm", "mlp_classifier"])
SCALERS = {"standard": lambda **k: T.StandardScaler(withMean=True, **k), "minmax": T.MinMaxScaler, "robust": T.RobustScaler, "maxabs": T.MaxAbsScaler}


def make_model(kind: str, features: list[str], scaler: str | None = None, label: str = "label") -> Pipeline:
    """Assembler, optional scaler and model; multi-layer perceptrons take their layers from the features."""
    column = "raw" if scaler else "features"
    stages = [T.VectorAssembler(inputCols=features, outputCol=column, handleInvalid="skip")]
    if scaler:
        stages.append(SCALERS[scaler](inputCol="raw", outputCol="features"))
    model = C.MultilayerPerceptronClassifier(layers=[len(features), 16, 2], seed=0) if kind == "mlp_classifier" else MODELS[kind]()
    return Pipeline(stages=[*stages, model.setLabelCol(label)])


def scoring(model: PipelineModel) -> PipelineModel:
    """A fitted pipeline for scoring: training leaves rows with nulls out, scoring answers every row (what it lacks is NaN to the model)."""
    return PipelineModel([model.stages[0].copy().setHandleInvalid("keep"), *model.stages[1:]])


#: Models that are fitted at a time, and rows of training data for a task.
AT_ONCE, ROWS_A_TASK = 4, 50_000


def dealt(df: DataFrame, row_id: str, rows: int) -> DataFrame:
    """``df`` in even parts by id, enough for all tasks: a fit passes over its rows hundreds of times, and small files would leave most cores idle."""
    most = max(48, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(min(most, rows // ROWS_A_TASK + 1), row_id)


def fit_all(pipelines: list[Pipeline], train: DataFrame) -> list[PipelineModel]:
    """The pipelines fitted on the same rows, some at a time: the jobs of one fill the gaps between those of another."""
    with ThreadPool(min(AT_ONCE, len(pipelines))) as pool:
        return pool.map(inheritable_thread_target(train.sparkSession)(lambda p: p.fit(train)), pipelines, chunksize=1)


def grid_search(df: DataFrame, kind: str, features: list[str], grid: dict[str, list], folds: int = 5, metric: str = "rmse") -> DataFrame:
    """One row per setting: its number and mean metric over the folds, which run in parallel."""
    pipeline = make_model(kind, features)
    model, build = pipeline.getStages()[-1], ParamGridBuilder()
    for name, values in grid.items():
        build = build.addGrid(model.getParam(name), values)
    maps = build.build()
    fitted = CrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=RegressionEvaluator(metricName=metric), numFolds=folds, seed=0, parallelism=4).fit(df)
    rows = [(i, "; ".join(f"{p.name}={v}" for p, v in m.items()), float(a)) for i, (m, a) in enumerate(zip(maps, fitted.avgMetrics))]
    return df.sparkSession.createDataFrame(rows, "setting int, params string, metric double")


def importances(model: PipelineModel, features: list[str]) -> DataFrame:
    """Importances of trees, coefficients of linear models."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return _rows([(f, float(v)) for f, v in zip(features, values.toArray())])


def _rows(rows: list[tuple[str, float]]) -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().createDataFrame(rows, "fname string, importance double")


def permutation_importance(model: PipelineModel, df: DataFrame, row_id: str, features: list[str], label: str = "label", repeats: int = 30) -> DataFrame:
    """(fname, drop): mean loss of r2 when a feature's values are dealt anew.

    Values swap within buckets of about a thousand rows, by hash, so a permutation is worked out within a bucket without a global order.
    """
    n = df.count()
    buckets = max(1, n // 1000)

    def score(x: DataFrame, by: list[str]) -> DataFrame:
        e = F.col(label) - F.col("prediction")
        return x.groupBy(*by).agg((1 - F.sum(e * e) / F.count(F.lit(1)) / F.var_pop(label)).alias("r2"))

    base = score(model.transform(df), []).first().r2  # one number
    # One shuffle deals all features: the row that is k-th by one order of its bucket takes the values of the k-th by the other.
    reps = df.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("_b", hash32("b", F.col("_r"), F.col(row_id)) % buckets)
    order = lambda tag: F.struct(hash32(tag, F.col("_r"), F.col(row_id)).alias("h"), F.col(row_id).alias("id"))
    values = F.struct(*features)
    held = reps.groupBy("_r", "_b").agg(F.collect_list(F.struct(order("to").alias("o"), F.struct(label, *features).alias("x"))).alias("to"), F.collect_list(F.struct(order("from").alias("o"), values.alias("x"))).alias("from"))
    dealt = held.select("_r", F.explode(F.arrays_zip(F.sort_array("to").alias("to"), F.sort_array("from").alias("from"))).alias("_z"))
    mixed = [F.struct(F.lit(f).alias("fname"), *[F.col(f"_z.{'from' if c == f else 'to'}.x.{c}").alias(c) for c in features]) for f in features]
    rows = dealt.select("_r", F.col(f"_z.to.x.{label}").alias(label), F.explode(F.array(*mixed)).alias("_m")).select("_r", label, "_m.*")
    out = score(model.transform(rows), ["fname", "_r"]).groupBy("fname").agg((F.lit(base) - F.avg("r2")).alias("drop"))
    return out
