"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The tables ``events`` etc. are views over the same parquet files. The CTEs
below restate the table mapping in SQL: transactions from events, serving
features, the rule score and the alerts table.
"""

from __future__ import annotations

from .. import schemas as S

AS_OF = "2024-01-30 00:00:00"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


TX = f"""
tx AS (
  SELECT 'TXN_' || CAST(event_id AS VARCHAR) AS transaction_id,
         'USER_' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS user_id,
         round(value * 10.0, 2) AS amount,
         ({_list(S.CURRENCIES)})[event_id % 3 + 1] AS currency,
         ({_list(S.MERCHANTS)})[k % 17 + 1] AS merchant,
         ts AS transaction_time,
         ({_list(S.COUNTRIES)})[k % 6 + 1] AS country,
         CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'view' THEN 'payment'
              WHEN 'click' THEN 'transfer' WHEN 'signup' THEN 'withdrawal'
              WHEN 'error' THEN 'refund' END AS transaction_type,
         ((value * 10.0 > 1000 AND k % 17 >= 14) OR event_id % 97 = 0) AS is_fraud_actual,
         ts AS created_at,
         event_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""

FEAT = f"""
feat AS (
  SELECT *, hour(transaction_time) AS hour,
         dayofweek(transaction_time) + 1 AS day_of_week,
         ln(1 + amount) AS amount_log,
         CASE WHEN hour(transaction_time) >= 22 OR hour(transaction_time) <= 6 THEN 1 ELSE 0 END AS is_night,
         CASE WHEN dayofweek(transaction_time) + 1 IN (1, 7) THEN 1 ELSE 0 END AS is_weekend,
         15 AS user_frequency,
         CASE WHEN amount > 1000 THEN 1 ELSE 0 END AS is_high_amount,
         CASE WHEN merchant IN {_in(S.RISKY_MERCHANTS)} THEN 1 ELSE 0 END AS is_unknown_merchant,
         CASE WHEN country IN {_in(S.FOREIGN_COUNTRIES)} THEN 1 ELSE 0 END AS is_foreign_country
  FROM tx
)"""

SCORED = """
scored AS (
  SELECT *, fraud_score > 0.7::DOUBLE AS is_fraud, 'rule_based' AS model_version
  FROM (SELECT *, least(0.0::DOUBLE
                 + CASE WHEN amount > 1000 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
                 + CASE WHEN is_night = 1 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
                 + CASE WHEN is_unknown_merchant = 1 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
                 + CASE WHEN is_foreign_country = 1 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE) AS fraud_score
        FROM feat)
)"""


def alerts_cte(name: str = "alerts", min_score: float | None = None) -> str:
    cond = "is_fraud" if min_score is None else f"fraud_score >= {min_score}::DOUBLE"
    return f"""
{name} AS (
  SELECT transaction_id, user_id, amount, merchant, fraud_score, TRUE AS is_fraud,
         model_version, transaction_time + INTERVAL 1 SECOND AS detection_time,
         transaction_time, ({_list(S.ALERT_STATUSES)})[event_id % 3 + 1] AS alert_status, event_id
  FROM scored WHERE {cond}
)"""


ALERTS = alerts_cte()
DENSE = alerts_cte("dense", 0.5)


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


BASE = with_(TX, FEAT, SCORED, ALERTS)
BASE_DENSE = with_(TX, FEAT, SCORED, ALERTS, DENSE)


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"
