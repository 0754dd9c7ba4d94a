"""Schemas and fixed domain values.

The constants below must equal the values of the system this library replaces
for results to match; they are stated as plain data, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# FIXED VALUES (domain constants; must stay exactly as written)
# --------------------------------------------------------------------------
MERCHANTS = [
    "Amazon", "Walmart", "Target", "Apple Store", "Best Buy",
    "Starbucks", "McDonald's", "Shell Gas", "Uber", "Netflix",
    "Steam Games", "PlayStation Store", "Microsoft", "Google Play",
    "Unknown Merchant", "Suspicious Shop", "Foreign Vendor",
]
RISKY_MERCHANTS = ["Unknown Merchant", "Suspicious Shop", "Foreign Vendor"]
CURRENCIES = ["USD", "EUR", "GBP"]
COUNTRIES = ["US", "UK", "FR", "DE", "CN", "RU"]
TRANSACTION_TYPES = ["purchase", "withdrawal", "transfer", "payment"]
FOREIGN_COUNTRIES = ["RU", "CN"]
HIGH_RISK_COUNTRIES = ["RU", "CN", "NG", "PK"]
HOME_COUNTRY = "US"
ALERT_STATUSES = ["pending", "confirmed", "dismissed"]

# Feature thresholds
HIGH_AMOUNT = 1000.0          # is_high_amount: amount > 1000
MICRO_AMOUNT = 10.0           # is_micro_transaction: amount < 10
NIGHT_FROM_HOUR = 22          # is_night: hour >= 22 or hour <= 6
NIGHT_TO_HOUR = 6
BUSINESS_FROM_HOUR = 9        # is_business_hours: 9 <= hour <= 17
BUSINESS_TO_HOUR = 17
WEEKEND_DAYS = [1, 7]         # dayofweek: 1 = Sunday, 7 = Saturday
HIGH_VELOCITY_COUNT = 5       # is_high_velocity: tx_count_1h > 5
DEFAULT_USER_FREQUENCY = 15   # serving placeholder when no user history is known
FIRST_TX_HOURS = 24.0         # hours_since_last_tx of a user's first transaction

# Rule score weights, summed in this order, clamped at 1.0; fraud if score > 0.7
RULE_WEIGHT_HIGH_AMOUNT = 0.3
RULE_WEIGHT_NIGHT = 0.2
RULE_WEIGHT_UNKNOWN_MERCHANT = 0.3
RULE_WEIGHT_FOREIGN = 0.2
RULE_FRAUD_THRESHOLD = 0.7
RULE_MODEL_VERSION = "rule_based"

# Alert rule thresholds
ALERT_HIGH_FRAUD_SCORE = 0.95       # declared, not part of the default rule set
ALERT_HIGH_AMOUNT = 5000.0
ALERT_RAPID_FRAUDS = 10
ALERT_FRAUD_RATE_SPIKE = 0.15
ALERT_MIN_ACCURACY = 0.85
ALERT_MIN_PRECISION = 0.75
ALERT_MIN_RECALL = 0.75

# Column length / precision limits of the stored tables
TRANSACTION_LIMITS = {
    "transaction_id": 100,
    "user_id": 50,
    "currency": 10,
    "merchant": 200,
    "country": 10,
    "transaction_type": 50,
}
AMOUNT_DECIMAL = (15, 2)
SCORE_DECIMAL = (5, 4)

# Alert records per rule: (alert_type, severity, message format)
ALERT_HIGH_VALUE = ("HIGH_VALUE_FRAUD", "CRITICAL", "High-value fraud detected: $%.2f for user %s")
ALERT_RATE_SPIKE = ("FRAUD_RATE_SPIKE", "HIGH", "Fraud rate spike detected: %.2f%%")
ALERT_RAPID_SEQUENCE = ("RAPID_FRAUD_SEQUENCE", "HIGH", "Rapid fraud sequence from user %s: %d frauds")
ALERT_MODEL_DEGRADATION = ("MODEL_PERFORMANCE_DEGRADATION", "MEDIUM", "Model %s performance below threshold")

# Audit events: (event_type, description format); alert events are "ALERT_" + alert_type
AUDIT_MODEL_REGISTERED = ("MODEL_REGISTERED", "New model version registered: %s")
AUDIT_MODEL_ACTIVATED = ("MODEL_ACTIVATED", "Model %s activated for production")
AUDIT_ALERT_PREFIX = "ALERT_"

# Cache keys and lifetimes: "fraud_alert:<transaction_id>", "alert:<type>:<epoch seconds>"
ALERT_PAYLOAD_PREFIX = "fraud_alert:"
RULE_ALERT_KEY_PREFIX = "alert"
ALERT_PAYLOAD_TTL = "1 hour"
RULE_ALERT_TTL = "1 hour"

# Alert table defaults and outer-join defaults
PENDING_STATUS = "pending"
NO_ALERT_STATUS = "n/a"
MODEL_VERSION_PREFIX = "fraud_model_"
DEFAULT_TOPIC = "banking-transactions"

# Serving/training feature order of the model
MODEL_FEATURES = [
    "amount", "hour", "day_of_week", "user_frequency", "amount_log",
    "is_night", "is_weekend", "is_high_amount", "is_unknown_merchant",
    "is_foreign_country", "merchant_encoded", "country_encoded",
    "transaction_type_encoded",
]
CATEGORICAL_FEATURES = ["merchant", "country", "transaction_type"]

TRANSACTION_MESSAGE = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("amount", T.DoubleType(), False),
    T.StructField("currency", T.StringType(), True),
    T.StructField("merchant", T.StringType(), True),
    T.StructField("transaction_time", T.StringType(), False),
    T.StructField("country", T.StringType(), True),
    T.StructField("transaction_type", T.StringType(), True),
    T.StructField("is_fraud_actual", T.BooleanType(), True),
])

HISTORICAL_TRANSACTION = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("amount", T.DoubleType(), False),
    T.StructField("currency", T.StringType(), True),
    T.StructField("merchant", T.StringType(), True),
    T.StructField("transaction_time", T.TimestampType(), False),
    T.StructField("country", T.StringType(), True),
    T.StructField("transaction_type", T.StringType(), True),
    T.StructField("is_fraud", T.IntegerType(), True),
])

REQUIRED_TRANSACTION_COLUMNS = ["transaction_id", "user_id", "amount", "transaction_time"]
# Filled in by a reviewer of an alert.
REVIEW_COLUMNS = T.StructType([
    T.StructField("reviewed_by", T.StringType()),
    T.StructField("reviewed_at", T.TimestampType()),
    T.StructField("notes", T.StringType()),
])

MODEL_INFO = T.StructType([
    T.StructField("model_type", T.StringType()),
    T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("metrics", T.StructType([
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1_score", T.DoubleType()),
        T.StructField("roc_auc", T.DoubleType()),
        T.StructField("feature_importance", T.MapType(T.StringType(), T.DoubleType())),
    ])),
    T.StructField("training_date", T.StringType()),
    T.StructField("version", T.StringType()),
])

EVALUATION_REPORT = T.StructType([
    T.StructField("model_version", T.StringType()),
    T.StructField("evaluation_date", T.StringType()),
    T.StructField("metrics", T.StructType([
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1_score", T.DoubleType()),
        T.StructField("roc_auc", T.DoubleType()),
    ])),
])

MODEL_PERFORMANCE = T.StructType([
    T.StructField("model_version", T.StringType(), False),
    T.StructField("accuracy", T.DecimalType(5, 4)),
    T.StructField("precision_score", T.DecimalType(5, 4)),
    T.StructField("recall", T.DecimalType(5, 4)),
    T.StructField("f1_score", T.DecimalType(5, 4)),
    T.StructField("training_date", T.TimestampType()),
    T.StructField("dataset_size", T.IntegerType()),
    T.StructField("feature_importance", T.StringType()),
    T.StructField("hyperparameters", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
])

ALERT_RECORD = T.StructType([
    T.StructField("alert_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])
# --------------------------------------------------------------------------
