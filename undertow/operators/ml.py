"""Training and scoring with pyspark.ml."""

from __future__ import annotations

from math import pi

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undertow.functions.scalars import centroid_or_zero, is_missing
from undertow.operators.metrics import precision_recall_f1
from undertow.operators.running import running


def train_val_split(rows: DataFrame, key: str, fifth: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """max(1, n // fifth) of the n rows validate: those of least hash of the key, the same for any partitioning."""
    order = F.xxhash64(F.col(key).cast("string"), F.lit(seed)).cast("double")
    ranked = running(rows.withColumn("_order", order), "_order", {"_rank": F.lit(1)}, [F.col(key)])
    n_val = F.greatest(F.lit(1), F.floor(rows.agg(F.count("*").alias("n")).scalar() / fifth))
    split = ranked.withColumn("_val", F.col("_rank") <= n_val)
    return split.where("not _val").select(*rows.columns), split.where("_val").select(*rows.columns)


def augment(rows: DataFrame, key: str, copies: int = 1, seed: int = 7) -> DataFrame:
    """Copies with Gaussian noise on both views, and shift, mask and scale of the global one; randomness from a hash of
    key and copy."""
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))

    def u(tag: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key), F.col("_copy"), F.lit(f"{seed}{tag}")), F.lit(1_000_000)) / 1e6

    g, n = F.col("global_view"), F.size("global_view")
    shift = F.when(u("s?") < 0.3, F.round((u("s") - 0.5) * 0.1 * n)).otherwise(0).cast("int")
    at = F.pmod(shift, n)
    g = F.concat(F.slice(g, at + 1, n), F.slice(g, 1, at))
    scale = F.when(u("x?") < 0.3, 0.95 + 0.1 * u("x")).otherwise(1.0)
    width, start = (n * (0.02 + 0.03 * u("w"))).cast("int"), (n * u("m")).cast("int")
    masked = u("m?") < 0.3
    noise = F.when(u("n?") < 0.5, 0.002).otherwise(0.0)

    def normal(i: Column, view: str) -> Column:
        """Box-Muller on two hashes."""
        a, b = ((F.pmod(F.xxhash64(F.col(key), F.col("_copy"), i, F.lit(f"{seed}{view}{k}")), F.lit(1_000_000)) + 0.5) / 1e6 for k in "ab")
        return F.sqrt(-2 * F.log(a)) * F.cos(2 * pi * b)

    def value(x: Column, i: Column) -> Column:
        return F.when(masked & (i >= start) & (i < start + width), 0.0).otherwise(x * scale + normal(i, "g") * noise)

    first = F.col("_copy") == 0
    local = F.transform("local_view", lambda x, i: x + normal(i, "l") * noise)
    return rows.withColumns({
        "global_view": F.when(first, F.col("global_view")).otherwise(F.transform(g, value)),
        "local_view": F.when(first, F.col("local_view")).otherwise(local),
    }).drop("_copy")


def fit_classifier(rows: DataFrame, kind: str = "logistic", **params) -> PipelineModel:
    """On arrays global_view, local_view and centroid_offset."""
    learner = {"logistic": LogisticRegression, "gbt": GBTClassifier}[kind](featuresCol="features", labelCol="label", **params)
    stages = [VectorAssembler(inputCols=["_g", "_l", "_c"], outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features"), learner]
    return _alone(Pipeline(stages=stages).fit(_vectors(rows)))


def _alone(model: PipelineModel) -> PipelineModel:
    """The model without its training summary, which holds the session: tasks can't take it once the session observes."""
    last = model.stages[-1]
    if getattr(last, "hasSummary", False):
        last._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_g": array_to_vector("global_view"), "_l": array_to_vector("local_view"), "_c": centroid_or_zero(F.col("centroid_offset"))})


def score_batch(rows: DataFrame, model: PipelineModel | None) -> DataFrame:
    """``prob_planet``; null without a model."""
    if model is None:
        return rows.withColumn("prob_planet", F.lit(None).cast("double"))
    told = model.transform(_vectors(rows)).withColumn("prob_planet", vector_to_array("probability")[1])
    return told.select(*rows.columns, "prob_planet")


def classify(rows: DataFrame) -> DataFrame:
    p = F.col("prob_planet")
    return rows.withColumns({"predicted": F.when(p.isNull(), None).when(p >= 0.5, 1).otherwise(0), "prob_fp": 1 - p})


def select_by_f1(train: DataFrame, val: DataFrame, grid: list[dict], patience: int | None = None) -> tuple[PipelineModel, float]:
    """Of the models of a small parameter grid, the one of best F1 on the validation rows; the first of equal ones.

    With ``patience`` the search ends once so many models in a row have brought no gain.
    """
    best: tuple[PipelineModel | None, float] = (None, -1.0)
    waited = 0
    for params in grid:
        model = fit_classifier(train, **params)
        f1 = precision_recall_f1(score_batch(val, model).select("label", F.col("prob_planet").alias("score"))).first()["f1"]
        best, waited = ((model, f1), 0) if f1 > best[1] else (best, waited + 1)
        if patience is not None and waited >= patience:
            break
    return best


def fit_boosted(train: DataFrame, val: DataFrame, rounds: int = 50, tolerance: float = 0.01, **params) -> tuple[PipelineModel, int]:
    """Boosted trees on the views that stop once validation rows gain no more than ``tolerance``, and their number."""
    both = _vectors(train.withColumn("_val", F.lit(False)).unionByName(val.withColumn("_val", F.lit(True)), allowMissingColumns=True))
    learner = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, validationIndicatorCol="_val", validationTol=tolerance, seed=42, **params)
    stages = [VectorAssembler(inputCols=["_g", "_l", "_c"], outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features")]
    scaler = Pipeline(stages=stages).fit(both.where("not _val"))
    model = learner.fit(scaler.transform(both))
    return PipelineModel([*scaler.stages, model]), model.getNumTrees


def fit_forest(rows: DataFrame, columns: list[str], **params) -> PipelineModel:
    """A random forest on named scalars. What is missing gets its column's median; a column without any value is 0."""
    known = rows.agg(*(F.count(F.when(~is_missing(F.col(c)), 1)).alias(c) for c in columns)).first()
    some = [c for c in columns if known[c]]
    filled = [f"_{c}" for c in some]
    learner = RandomForestClassifier(featuresCol="features", labelCol="label", seed=42, **params)
    stages = [Imputer(inputCols=some, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="features"), learner]
    return _alone(Pipeline(stages=stages).fit(rows))


def score_forest(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """``rows`` plus ``prob_planet``."""
    told = model.transform(rows).withColumn("prob_planet", vector_to_array("probability")[1])
    return told.select(*rows.columns, "prob_planet")


def importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """feature, importance: each scalar's share of a forest's gain."""
    names = [c.removeprefix("_") for c in model.stages[1].getInputCols()]
    return spark.createDataFrame(list(zip(names, map(float, model.stages[-1].featureImportances.toArray()), strict=True)), "feature string, importance double")


def save_model(model: PipelineModel, scores: DataFrame | None, path: str) -> None:
    """The model, and its one row of metrics beside it; an older one is replaced."""
    model.write().overwrite().save(f"{path}/model")
    if scores is not None:
        scores.write.mode("overwrite").json(f"{path}/metrics")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def score_with(rows: DataFrame, make_predict, batch_size: int = 32, width: int | None = None) -> DataFrame:
    """``prob_planet`` by a user's own model. ``make_predict`` returns a function from a NumPy matrix, a row for each
    series (global view, local view, centroid, ``width`` numbers in all), to probabilities; it is called once in each
    Python worker. Without ``width`` a first row is looked at."""
    if width is None:
        first = rows.select((F.size("global_view") + F.size("local_view") + 1).alias("n")).first()
        width = first["n"] if first else 1
    predict = predict_batch_udf(make_predict, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[width]])
    return rows.withColumn("prob_planet", predict(F.concat("global_view", "local_view", F.array(centroid_or_zero(F.col("centroid_offset"))))))
