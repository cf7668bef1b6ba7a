"""Supervised classifiers on pyspark.ml."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.ml.scaling import class_weight, positive_ratio, with_weight
from txrisk.operators import metrics
from txrisk.operators.splits import assign_folds
from txrisk.schema import COLUMNS, SEED

# Learning settings of the classifier. Trees here grow by level, so 31 leaves
# become a depth of 5.
BOOSTING = {
    "stepSize": 0.1, "maxDepth": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.9",
}
MAX_ROUNDS, PATIENCE = 1000, 100


def _assemble(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="_features", handleInvalid="keep")


@dataclass
class Boosting:
    """A boosted model cut to its best prefix, and how it was found."""

    model: PipelineModel
    curve: list[float]  # held-out loss after each round that was looked at; empty without held-out rows
    best_round: int
    ratio: float  # weight of a positive row


def best_prefix(curve: Sequence[float], patience: int) -> tuple[int, bool]:
    """Rounds of the first least loss seen before ``patience`` rounds bring no less, and whether it came to that."""
    best = 0
    for t, loss in enumerate(curve):
        if loss < curve[best]:
            best = t
        elif t - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model of the first ``rounds`` trees: what boosting that ended there would have given."""
    spark = SparkSession.getActiveSession()
    gateway, whole = spark.sparkContext._gateway, model._java_obj
    trees, weights = whole.trees(), whole.treeWeights()
    kept = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    share = gateway.new_array(gateway.jvm.double, rounds)
    for i in range(rounds):
        kept[i], share[i] = trees[i], weights[i]
    made = gateway.jvm.org.apache.spark.ml.classification.GBTClassificationModel(whole.uid(), kept, share, whole.numFeatures(), 2)
    return model._copyValues(GBTClassificationModel(made))


def boost(
    train: DataFrame,
    columns: Sequence[str],
    label: str = COLUMNS.label,
    validation: str | None = None,
    rounds: int = MAX_ROUNDS,
    seed: int = SEED,
    weighted: bool = True,
    patience: int = PATIENCE,
) -> Boosting:
    """Gradient-boosted trees, positives weighted by neg/pos, at most ``rounds`` rounds.

    ``validation`` names a boolean column: its rows are held out, and the model keeps the rounds after which their
    (weighted) log-loss was least, once ``patience`` further rounds brought none that is less. A loss that rises and falls
    again is followed that far. Boosting cannot be taken up again where it ended, but repeats itself exactly, so it
    runs with doubled rounds until the patience is used up: less than twice the work of the last run. Growth is by
    level, so a model agrees with a leaf-wise one in quality, not number for number.
    """
    ratio = positive_ratio(train, label) if weighted else 1.0
    data = _assemble(columns).transform(with_weight(train, ratio, label))
    fitted = data.filter(~F.col(validation)) if validation else data
    size = min(rounds, patience + patience // 2 + 1) if validation else rounds
    while True:
        booster = GBTClassifier(featuresCol="_features", labelCol=label, weightCol="weight", maxIter=size, seed=seed, **BOOSTING)
        model, curve, best = booster.fit(fitted), [], size
        if validation:
            curve = model.evaluateEachIteration(data.filter(F.col(validation)))
            best, settled = best_prefix(curve, patience)
            if not settled and size < rounds:
                size = min(rounds, 2 * size)
                continue
            if best < size:
                model = first_trees(model, best)
        return Boosting(PipelineModel([_assemble(columns), model]), list(curve), best, ratio)


def fit_boosting(train: DataFrame, columns: Sequence[str], *args, **settings) -> PipelineModel:
    """The model of :func:`boost`."""
    return boost(train, columns, *args, **settings).model


def fit_random_forest(
    train: DataFrame, columns: Sequence[str], label: str = COLUMNS.label, trees: int = 100, depth: int = 20,
    seed: int = SEED,
) -> PipelineModel:
    """Class-weighted random forest."""
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed
    )
    return Pipeline(stages=[_assemble(columns), forest]).fit(class_weight(train, label))


def predict(model: PipelineModel, df: DataFrame, threshold: float = 0.5, out: str = "fraud_probability") -> DataFrame:
    """M12 (and M16): probability of the positive class and the decision at ``threshold``."""
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.withColumn("fraud_prediction", (F.col(out) >= threshold).cast("int")).drop(
        "_features", "rawPrediction", "probability", "prediction"
    )


def as_scored(predicted: DataFrame, label: str = COLUMNS.label, score: str = "fraud_probability") -> DataFrame:
    """The (y, p) table that the evaluation operators read."""
    keys = [COLUMNS.id] if COLUMNS.id in predicted.columns else []
    return predicted.select(*keys, F.col(label).cast("int").alias("y"), F.col(score).alias("p"))


def feature_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Gain and split counts per feature, raw and as shares. One row per feature of the model."""
    columns = model.stages[0].getInputCols()
    booster = model.stages[-1]
    splits = Counter(int(i) for i in re.findall(r"If \(feature (\d+)", booster.toDebugString))
    gain = booster.featureImportances.toArray()
    total = max(1, sum(splits.values()))
    rows = [(c, float(gain[i]), splits.get(i, 0), splits.get(i, 0) / total) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "feature string, gain double, splits int, split_share double")


def evaluate(model: PipelineModel, df: DataFrame, threshold: float = 0.5, label: str = COLUMNS.label) -> DataFrame:
    """M14."""
    return metrics.compact(as_scored(predict(model, df, threshold), label), threshold)


def cross_validate(
    df: DataFrame, columns: Sequence[str], folds: int = 5, rounds: int = 100, seed: int = SEED
) -> DataFrame:
    """Mean, deviation, minimum and maximum ROC-AUC over exact stratified folds.

    Each fold fits on the others; the held-out scores of all folds are evaluated together, per fold.
    """
    folded = assign_folds(df, folds, seed=seed)
    held = None
    for i in range(folds):
        model = fit_boosting(folded.filter(F.col("fold") != i), columns, rounds=rounds, seed=seed)
        out = predict(model, folded.filter(F.col("fold") == i))
        part = out.select("fold", F.col(COLUMNS.label).alias("y"), F.col("fraud_probability").alias("p"))
        held = part if held is None else held.unionByName(part)
    per_fold = metrics.areas(metrics.curve(held, by=["fold"]), by=["fold"])
    return per_fold.agg(
        F.count("*").alias("n_folds"),
        F.avg("roc_auc").alias("mean_score"),
        F.stddev_pop("roc_auc").alias("std_score"),
        F.min("roc_auc").alias("min_score"),
        F.max("roc_auc").alias("max_score"),
    )
