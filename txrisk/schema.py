"""Schemas, column names and fixed parameters of the library."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import types as T

S, D, I, L, TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.TimestampType()


def struct(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


TRANSACTION = struct(
    ("transaction_id", S), ("timestamp", TS), ("sender_account", S), ("receiver_account", S),
    ("amount", D), ("transaction_type", S), ("merchant_category", S), ("location", S),
    ("device_used", S), ("is_fraud", I),
)
EXTENDED_TRANSACTION = struct(
    *[(f.name, f.dataType) for f in TRANSACTION.fields],
    ("fraud_type", S), ("time_since_last_transaction", D), ("spending_deviation_score", D),
    ("velocity_score", D), ("geo_anomaly_score", D), ("payment_channel", S),
    ("ip_address", S), ("device_hash", S),
)
# Requests arrive as text: the fields may be missing, empty or not yet typed.
REQUEST = struct(*[(f.name, S) for f in TRANSACTION.fields if f.name != "is_fraud"])

PREDICTION = struct(
    ("transaction_id", S), ("fraud_probability", D), ("anomaly_score", D), ("risk_level", S),
    ("fraud_prediction", I), ("explanation", S), ("processed_at", TS), ("model_version", S),
    ("is_fallback", T.BooleanType()), ("has_error", T.BooleanType()),
    ("error_type", S), ("error_message", S),
)
EVALUATION = struct(
    ("model_name", S), ("dataset_type", S), ("train_samples", L), ("test_samples", L),
    ("train_fraud_rate", D), ("test_fraud_rate", D), ("accuracy", D), ("precision", D),
    ("recall", D), ("f1_score", D), ("roc_auc", D), ("pr_auc", D), ("true_positives", L),
    ("true_negatives", L), ("false_positives", L), ("false_negatives", L),
    ("fraud_detection_rate", D), ("false_positive_rate", D), ("customer_friction_rate", D),
    ("optimal_threshold", D), ("threshold_low", D), ("threshold_high", D),
    ("training_time", D), ("evaluation_time", D),
)
REGISTRY = struct(("name", S), ("version", S), ("created_at", TS), ("size_bytes", L), ("path", S))


@dataclass(frozen=True)
class Columns:
    """Logical to physical column names of a transaction table."""

    id: str = "transaction_id"
    time: str = "timestamp"
    sender: str = "sender_account"
    receiver: str = "receiver_account"
    amount: str = "amount"
    location: str = "location"
    device: str = "device_used"
    label: str = "is_fraud"

    def required(self) -> list[str]:
        return [self.id, self.time, self.sender, self.receiver, self.amount]


COLUMNS = Columns()

# Risk bands, contamination and default label rate.
LOW_RISK, HIGH_RISK = 0.3, 0.7
ALTERNATIVE_BANDS = {"conservative": (0.4, 0.8), "aggressive": (0.2, 0.6)}
CONTAMINATION = 0.04
DEFAULT_LABEL_RATE = 0.04
# The two cost models.
UNIT_COSTS = {"fraud_value": 100.0, "false_positive_cost": 5.0}
DETAILED_COSTS = {"fraud_amount": 150.0, "investigation": 10.0, "service": 25.0, "recovered": 0.8}
SEED = 42


def component_seed(name: str, base: int = SEED) -> int:
    """A stable seed per component, from the SHA-256 of its name."""
    return (base + int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)) % (2**31 - 1)
