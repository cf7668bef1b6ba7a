"""The risk model: fit on labelled transactions, score tables and streams."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalars import probability
from txrisk.ml import boosting
from txrisk.ml.forest import DeepForest, ForestSettings, fit_forest, pack_nodes
from txrisk.operators import features, metrics, quality, registry
from txrisk.operators.decision import decision, explanation, risk_level
from txrisk.operators.preprocess import Preprocessor, PreprocessorModel
from txrisk.operators.splits import stratified_split
from txrisk.schema import COLUMNS, Columns, component_seed
from txrisk.session import materialise, ship
from txrisk.sources.readers import normalise_requests, one_transaction

CATEGORIES = ["transaction_type", "merchant_category", "location", "device_used"]
VERSION = "txrisk_v1.0"


@dataclass
class Past:
    """Earlier rows as scoring needs them, prepared by the model: the last day as rows, the rest as sums."""

    recent: DataFrame
    seen: DataFrame  # features.seen_values
    pairs: DataFrame  # features.pair_totals
    upto_row: bool = False  # pair features count rows up to the row itself


@dataclass
class RiskModel:
    """Preprocessing, features, anomaly forest, classifier and tuned thresholds as one model."""

    prep: PreprocessorModel
    bounds: dict[str, tuple[float, float]]
    feature_names: list[str]
    forest: DeepForest
    classifier: PipelineModel
    thresholds: dict[str, float]
    receivers: DataFrame  # statistics of the receivers in the training rows
    receiver_mode: str = "point_in_time"
    cols: Columns = COLUMNS
    own: DataFrame | None = None  # what each training row added to them
    fills: dict[str, object] = field(default_factory=dict)  # V10
    ends: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)  # V11
    schema: T.StructType | None = None  # of the rows it was fitted on
    training: dict[str, object] = field(default_factory=dict)  # sizes, rounds and quality of the fit

    # ------------------------------------------------------------------ fit

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        cols: Columns = COLUMNS,
        validation_share: float = 0.2,
        rounds: int = boosting.MAX_ROUNDS,
        forest: ForestSettings = ForestSettings(),
        receiver_mode: str = "point_in_time",
        tune: bool = True,
        patience: int = boosting.PATIENCE,
    ) -> "RiskModel":
        """M17. Failures raise; nothing is replaced by neutral rows behind the caller's back.

        Receiver features of a training row count earlier rows only, and scoring takes them from the statistics
        stored with the model. ``receiver_mode="batch"`` is the original's way: in training every row counts, its own too.
        """
        clean = quality.sanitise(quality.require_columns(df, [*cols.required(), cols.label]))
        kinds = [c for c in CATEGORIES if c in clean.columns]
        prep = Preprocessor(cols.time, [cols.amount], kinds).fit(clean)
        ready = prep.transform(clean)
        ends = quality.finite_ends(ready)
        ready = quality.make_finite(ready, ends)
        fills = quality.null_fills(ready.drop(cols.id, cols.sender, cols.receiver, cols.label, cols.time))
        ready = quality.fill_nulls(ready, fills)
        amounts = [c for c in (cols.amount, f"{cols.amount}_original") if c in ready.columns]
        bounds = quality.outlier_bounds(ready, amounts)
        # Written once before the features, of which each reads it anew, and once with them, for every later stage (medians,
        # trees, boosting, tuning). The side of a row is found on the few columns and kept with it.
        ready = materialise(quality.dedupe_rows(quality.clip_columns(ready, bounds)), "ready")
        sided = stratified_split(ready, validation_share, cols, component_seed("train_test_split"))
        split = materialise(features.engineer(sided, cols, receiver_mode=receiver_mode), "features")
        receivers = materialise(features.receiver_stats(ready, cols), "receivers")
        own = materialise(features.contributions(ready, cols), "own")
        names = features.feature_columns(split, cols, skip=kinds)
        train = split.filter("split = 'train'")
        detector = fit_forest(train, names, cols.id, forest)
        scored = materialise(
            integrate(detector, split, names).withColumn("_held_out", F.col("split") == "test"), "scored"
        )
        inputs = [*names, "anomaly_score"]
        found = boosting.boost(
            scored, inputs, cols.label, "_held_out", rounds, component_seed("classifier"), patience=patience
        )
        model = cls(prep, bounds, names, detector, found.model, {}, receivers, receiver_mode, cols, own, fills, ends, clean.schema)
        judged = boosting.predict(found.model, scored)
        judged = materialise(judged.select(F.col(cols.label).cast("int").alias("y"), F.col("fraud_probability").alias("p"), "_held_out"), "judged")
        model.training = training_facts(judged, len(names), found)
        if tune:
            points = metrics.curve_points(judged.filter("_held_out"))
            tuned = metrics.tuned_thresholds(points).collect()  # at most six rows
            model.thresholds = {r["strategy"]: r["threshold"] for r in tuned}
        return model

    @property
    def threshold(self) -> float:
        return self.thresholds.get("f1_optimal", 0.5)

    # -------------------------------------------------------------- scoring

    def check(self, df: DataFrame) -> dict:
        """V14 for rows to be scored: columns and types against those of the fit; the label may be absent."""
        wanted = T.StructType([f for f in self.schema.fields if f.name != self.cols.label])
        return quality.compare_schema(df, wanted)

    def prepared(self, df: DataFrame) -> DataFrame:
        """Rows as the fit had them before features: encoded, finite, without holes, within bounds."""
        ready = quality.make_finite(self.prep.transform(df), self.ends)
        return quality.clip_columns(quality.fill_nulls(ready, self.fills), self.bounds)

    def features(self, df: DataFrame, history: DataFrame | Past | None = None) -> DataFrame:
        """Preprocessed and engineered rows, with every feature the model was fitted on.

        Labels are set aside before features are made, so they never reach a score. Of ``history``, earlier rows as a table,
        only the rows of the senders at hand are looked at, and of these only the last day as rows.
        """
        label, cols = self.cols.label, self.cols
        ready = self.prepared(df.withColumnRenamed(label, "_set_aside"))
        if history is not None:
            return self.completed(ready, history if isinstance(history, Past) else self.past_of(ready, history))
        return self.whole(features.engineer(ready, cols, stats=self.receivers, own=self.own))

    def completed(self, ready: DataFrame, past: Past) -> DataFrame:
        """Engineered rows of prepared ones on top of their past."""
        return self.whole(features.engineer_on(
            ready, past.recent, past.seen, past.pairs, self.receivers, self.cols, self.own, past.upto_row
        ))

    def whole(self, table: DataFrame) -> DataFrame:
        """With the label back and every feature of the fit."""
        table = table.withColumnRenamed("_set_aside", self.cols.label)
        absent = [c for c in self.feature_names if c not in table.columns]
        return table.withColumns({c: F.lit(0.0) for c in absent}) if absent else table

    def past_of(self, ready: DataFrame, history: DataFrame) -> Past:
        """What scoring ``ready`` (prepared rows) needs of a table of earlier rows: those of its senders."""
        cols = self.cols
        senders = ready.filter(F.col(cols.sender).isNotNull()).select(cols.sender).distinct()
        theirs = self.prepared(quality.coerce_amounts(quality.trim_text(history.drop(cols.label))).join(senders, cols.sender, "left_semi"))
        start = ready.agg((F.min(cols.time) - F.expr("INTERVAL 24 HOURS")).alias("t")).scalar()
        return Past(theirs.filter(F.col(cols.time) >= start), features.seen_values(theirs, cols), features.pair_totals(theirs, cols))

    def transform(
        self, df: DataFrame, history: DataFrame | Past | None = None, scale: str = "fitted", explain: bool = True
    ) -> DataFrame:
        """One prediction row per transaction, keyed by its id.

        Rows that cannot be scored come back as error rows; all others are scored. ``history`` holds
        earlier transactions, so that a batch's windows do not begin at its own first row.
        """
        good, bad = self.judged(df)
        return self.predictions(self.features(good, history), bad, scale, explain)

    def judged(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Clean rows that can be scored, and the others with the kind and message of their error."""
        clean = quality.coerce_amounts(quality.trim_text(quality.require_columns(df, self.cols.required())))
        kind, message = quality.row_error(self.cols)
        judged = clean.withColumns({"_kind": kind, "_message": message})
        return judged.filter("_kind IS NULL").drop("_kind", "_message"), judged.filter("_kind IS NOT NULL")

    def predictions(self, table: DataFrame, bad: DataFrame, scale: str = "fitted", explain: bool = True) -> DataFrame:
        """Prediction rows of engineered rows, and error rows."""
        scored = boosting.predict(self.classifier, integrate(self.forest, table, self.feature_names, scale))
        p, a = probability(F.col("fraud_probability")), probability(F.col("anomaly_score"))
        rows = scored.withColumns({"fraud_probability": p, "anomaly_score": a})
        p, a, level = F.col("fraud_probability"), F.col("anomaly_score"), risk_level(F.col("fraud_probability"))
        out = quality.as_predictions(
            rows,
            {
                "transaction_id": F.col(self.cols.id),
                "fraud_probability": p,
                "anomaly_score": a,
                "risk_level": level,
                "fraud_prediction": decision(p, self.threshold),
                "explanation": explanation(p, level, a) if explain else F.lit(None),
                "processed_at": F.current_timestamp(),
                "model_version": F.lit(VERSION),
                "is_fallback": F.lit(False),
                "has_error": F.lit(False),
            },
        )
        errors = quality.error_predictions(bad, F.col("_kind"), F.col("_message"), self.cols.id)
        return out.unionByName(errors)

    def score_one(self, spark: SparkSession, body: str, history: DataFrame | None = None) -> DataFrame:
        """One transaction as JSON text."""
        return self.transform(normalise_requests(one_transaction(spark, body)), history)

    # ----------------------------------------------------------- persistence

    def save(self, spark: SparkSession, path: str) -> None:
        """State as JSON lines, tree nodes as Parquet, ML stages by their own writers."""
        f = self.forest
        state = {
            "bounds": self.bounds, "feature_names": self.feature_names, "thresholds": self.thresholds,
            "cols": asdict(self.cols), "receiver_mode": self.receiver_mode, "fills": self.fills, "ends": self.ends,
            "schema": self.schema.jsonValue(), "training": self.training,
            "forest": {
                "columns": f.columns, "fills": f.fills, "scale": f.scale, "sample": f.sample,
                "offset": f.offset, "ends": f.ends, "settings": asdict(f.settings),
            },
        }
        spark.createDataFrame([(json.dumps(state),)], "value string").write.mode("overwrite").text(f"{path}/state")
        nodes = pd.concat(
            [
                pd.DataFrame(t).assign(tree=number, node=np.arange(len(t["feature"])))
                for number, t in f.trees.items()
            ]
        )
        spark.createDataFrame(nodes).write.mode("overwrite").parquet(f"{path}/nodes")
        self.receivers.write.mode("overwrite").parquet(f"{path}/receivers")
        self.own.write.mode("overwrite").parquet(f"{path}/own")
        self.prep.write().overwrite().save(f"{path}/prep")
        self.classifier.write().overwrite().save(f"{path}/classifier")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RiskModel":
        state = json.loads(ship(spark).read.text(f"{path}/state").first()[0])
        s = state["forest"]
        forest = DeepForest(
            s["columns"], s["fills"], {c: tuple(v) for c, v in s["scale"].items()},
            pack_nodes(spark.read.parquet(f"{path}/nodes").collect()), s["sample"], s["offset"],
            tuple(s["ends"]), ForestSettings(**s["settings"]),
        )
        return cls(
            PreprocessorModel.load(f"{path}/prep"), {c: tuple(v) for c, v in state["bounds"].items()},
            state["feature_names"], forest, PipelineModel.load(f"{path}/classifier"), state["thresholds"],
            spark.read.parquet(f"{path}/receivers"), state["receiver_mode"], Columns(**state["cols"]),
            spark.read.parquet(f"{path}/own"), state["fills"], {c: tuple(v) for c, v in state["ends"].items()},
            T.StructType.fromJson(state["schema"]), state["training"],
        )

    def publish(self, spark: SparkSession, root: str, name: str = "risk_model") -> dict:
        """Save the model under ``root`` and commit its registry row with schema, sizes and statistics."""
        return registry.publish(
            spark, root, name, lambda path: self.save(spark, path),
            {"model_type": type(self).__name__, "schema": self.schema.json(), "statistics": json.dumps(self.training)},
        )


def training_facts(judged: DataFrame, n_features: int, found: boosting.Boosting) -> dict[str, object]:
    """Sizes, label rates, rounds and metrics at 0.5 of the training and the validation rows."""
    full = metrics.comprehensive(judged, 0.5, by=["_held_out"]).collect()  # two rows at most
    facts: dict[str, object] = {
        "n_features": n_features, "best_iteration": found.best_round, "rounds_looked_at": len(found.curve),
        "scale_pos_weight": found.ratio, "best_loss": min(found.curve, default=None),
    }
    for r in full:
        side = "val" if r["_held_out"] else "train"
        facts |= {f"n_{side}_samples": r["total_transactions"], f"fraud_rate_{side}": r["fraud_rate"], f"{side}_auc": r["roc_auc"],
                  f"{side}_precision": r["precision"], f"{side}_recall": r["recall"], f"{side}_f1": r["f1_score"]}
    return facts


def integrate(forest: DeepForest, table: DataFrame, names: list[str], scale: str = "fitted") -> DataFrame:
    """the anomaly score as one more feature; inputs imputed and clipped, the score within [0, 1]."""
    scored = forest.transform(table, "anomaly_score", scale)
    score = F.least(F.greatest(F.col("anomaly_score"), F.lit(0.0)), F.lit(1.0))
    kept = [c for c in table.columns if c not in names]
    return scored.select(*kept, *names, score.alias("anomaly_score"))


