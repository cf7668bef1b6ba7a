"""The same questions in plain SQL over the driver's tables, for the side-by-side check."""

from __future__ import annotations

from txrisk.operators import permute
from txrisk.operators.metrics import KEY_THRESHOLDS, SEARCH, SWEEP

TX = """tx AS (
 SELECT CAST(event_id AS VARCHAR) AS transaction_id, event_id AS n, ts AS "timestamp",
  'S' || user_id AS sender_account, 'R' || k AS receiver_account, value AS amount,
  event_type AS transaction_type, 'M' || (event_id % 8) AS merchant_category,
  'L' || ((user_id + k) % 6) AS location, 'D' || (k % 4) AS device_used,
  CASE WHEN event_type = 'error' AND k < 20 THEN 1 ELSE 0 END AS is_fraud, k
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e)"""

TIES = """tx AS (SELECT * REPLACE (date_trunc('hour', "timestamp") AS "timestamp") FROM tx0)"""

WIDE = """tx AS (
 SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS transaction_id,
  l_shipdate AS "timestamp", CAST(l_suppkey AS VARCHAR) AS sender_account,
  CAST(l_partkey AS VARCHAR) AS receiver_account, l_extendedprice AS amount
 FROM lineitem)"""

DIRTY = """dirty AS (
 SELECT transaction_id, n, "timestamp",
  CASE WHEN n % 101 = 0 THEN NULL ELSE sender_account END AS sender_account, receiver_account,
  CASE WHEN n % 13 = 0 THEN NULL WHEN n % 997 = 0 THEN amount * 1000 ELSE amount END AS amount,
  transaction_type, merchant_category,
  CASE WHEN n % 7 = 0 THEN '  ' || location || ' ' ELSE location END AS location,
  CASE WHEN n % 17 = 0 THEN '' ELSE device_used END AS device_used, is_fraud
 FROM tx, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR n % 50 = 0)"""

SCORED = """scored AS (
 SELECT CAST(event_id AS VARCHAR) AS transaction_id, y,
  ((k * 37 + event_id * 11) % 600 + 400 * y) / 1000.0::DOUBLE AS p
 FROM (SELECT *, CASE WHEN event_type = 'error' AND k < 20 THEN 1 ELSE 0 END AS y
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e) e)"""

CURVE = """g AS (SELECT p AS threshold, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM scored GROUP BY p),
 cv AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
  sum(pos) OVER () AS cp, sum(neg) OVER () AS cn FROM g),
 pts AS (SELECT threshold, tp, fp, cp, cn, tp / (tp + fp) AS "precision", tp / cp AS recall, fp / cn AS fpr,
  tp / cp AS tpr FROM cv)"""


# Each minority row's nearest others by brute force, and draws between them.
SMOTE = [
    """places AS (SELECT list(DISTINCT location ORDER BY location) AS p FROM tx)""",
    """m AS (SELECT row_number() OVER (ORDER BY transaction_id) AS r, amount AS a, k::DOUBLE AS b, hour("timestamp")::DOUBLE AS c,
 (list_position(p, location) - 1)::DOUBLE AS d FROM tx, places WHERE is_fraud = 1)""",
    """sizes AS (SELECT (SELECT count(*) FROM m) AS n, (SELECT count(*) FROM tx WHERE is_fraud = 0) AS others)""",
    """near AS (SELECT x.r, y.a, y.b, y.c, y.d, row_number() OVER (PARTITION BY x.r ORDER BY (x.a - y.a) * (x.a - y.a)
 + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c) + (x.d - y.d) * (x.d - y.d), y.r) AS nth
 FROM m x JOIN m y ON x.r <> y.r)""",
    """draws AS (SELECT j AS draw, ('0x' || substr(md5('42:row:' || j), 1, 15))::BIGINT % n + 1 AS r,
 ('0x' || substr(md5('42:near:' || j), 1, 15))::BIGINT % 5 + 1 AS nth,
 (('0x' || substr(md5('42:share:' || j), 1, 15))::BIGINT % 1000000) / 1000000.0::DOUBLE AS u
 FROM sizes, (SELECT unnest(range((SELECT others - n FROM sizes))) AS j) g)""",
    """made AS (SELECT draw, round(m.a + u * (near.a - m.a), 6) AS amount, round(m.b + u * (near.b - m.b), 6) AS k,
 round(m.c + u * (near.c - m.c), 6) AS hour,
 p[trunc(least(greatest(m.d + u * (near.d - m.d), 0), len(p) - 1))::INTEGER + 1] AS location, 1 AS is_fraud
 FROM draws JOIN m USING (r) JOIN near USING (r, nth), places)""",
]


def permutation_sql(places: str) -> str:
    """Recursive tables that end in ``permuted`` (key, place, rank): ``places`` gives rows (n, key, place).

    One step of the recursion is a round of the network, or its next beginning where a value is n or more.
    """
    mask = "((1::BIGINT << half) - 1)"
    mixed = f"(xor(a, a >> 15) * {permute.SECOND}) % {permute.PRIME}"
    return f"""start AS (
 SELECT *, greatest(1, ceil(ceil(log2(greatest(n, 2))) / 2))::BIGINT AS half FROM ({places}) p),
keys AS (SELECT key, i, ('0x' || substr(md5(key || ':' || i), 1, 7))::BIGINT AS k
 FROM (SELECT DISTINCT key FROM start) s, range({permute.ROUNDS}) t(i)),
walk(key, place, n, half, i, l, r) AS (
 SELECT key, place::BIGINT, n::BIGINT, half, 0::BIGINT, place >> half, place & {mask} FROM start
 UNION ALL
 SELECT key, place, n, half, CASE WHEN i < {permute.ROUNDS} THEN i + 1 ELSE 0 END,
  CASE WHEN i < {permute.ROUNDS} THEN r ELSE l END,
  CASE WHEN i < {permute.ROUNDS} THEN xor(l, xor(b, b >> 13) & {mask}) ELSE r END
 FROM (SELECT *, {mixed} AS b FROM (SELECT w.*, ((r + coalesce(k, 0)) * {permute.FIRST}) % {permute.PRIME} AS a
  FROM walk w LEFT JOIN keys USING (key, i)) x) y
 WHERE i < {permute.ROUNDS} OR ((l << half) | r) >= n),
permuted AS (SELECT key, place, (l << half) | r AS rank FROM walk WHERE i = {permute.ROUNDS} AND ((l << half) | r) < n)"""


def q(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def level(p: str = "p", low: float = 0.3, high: float = 0.7) -> str:
    return f"CASE WHEN {p} < {low} THEN 'low' WHEN {p} >= {high} THEN 'high' ELSE 'medium' END"


def grid(values) -> str:
    return "grid(threshold) AS (VALUES " + ", ".join(f"({v!r}::DOUBLE)" for v in values) + ")"


SWEPT = """counts AS (SELECT threshold,
  sum(CASE WHEN y = 1 AND p >= threshold THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y = 0 AND p >= threshold THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y = 1 AND p < threshold THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN y = 0 AND p < threshold THEN 1 ELSE 0 END) AS tn
 FROM scored, grid GROUP BY threshold),
 pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS "precision",
  CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall FROM counts),
 swept AS (SELECT *,
  CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END AS f1_score,
  CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END AS false_positive_rate,
  CASE WHEN fp + tn > 0 THEN tn::DOUBLE / (fp + tn) ELSE 0 END AS specificity,
  (tp + fp)::DOUBLE / (tp + fp + fn + tn) AS customer_friction_rate,
  (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy FROM pr)"""


def swept(values) -> list[str]:
    return [SCORED, grid(values), SWEPT]


def r6(*names: str) -> str:
    return ", ".join(f'round("{n}", 6) AS "{n}"' for n in names)


def big(*names: str) -> str:
    return ", ".join(f"{n}::BIGINT AS {n}" for n in names)


# Money is whole cents, so averages often end in an exact 5, where summation noise would decide
# the rounding. Here and in the Spark queries such values move by the same 1.37e-7 first.
SENDER = """SELECT transaction_id,
 n1::BIGINT AS tx_count_last_1h, n24::BIGINT AS tx_count_last_24h, round(s24, 4) AS total_amount_last_24h,
 round(CASE WHEN n24 > 0 THEN s24 / n24 ELSE 0 END + 1.37e-7, 4) AS avg_amount_last_24h,
 round(m24, 4) AS max_amount_last_24h, round(s1, 4) AS velocity_1h, round(s24 / 24 + 1.37e-7, 4) AS velocity_24h
 FROM (SELECT transaction_id,
  count(*) OVER w1 + count(*) OVER pe AS n1, count(*) OVER w24 + count(*) OVER pe AS n24,
  coalesce(sum(amount) OVER w1, 0) + coalesce(sum(amount) OVER pe, 0) AS s1,
  coalesce(sum(amount) OVER w24, 0) + coalesce(sum(amount) OVER pe, 0) AS s24,
  greatest(coalesce(max(amount) OVER w24, 0), coalesce(max(amount) OVER pe, 0)) AS m24
 FROM tx WINDOW
  w1 AS (PARTITION BY sender_account ORDER BY "timestamp"
   RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW EXCLUDE GROUP),
  w24 AS (PARTITION BY sender_account ORDER BY "timestamp"
   RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW EXCLUDE GROUP),
  pe AS (PARTITION BY sender_account, "timestamp" ORDER BY transaction_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) s"""

TIME = """SELECT transaction_id, hour::BIGINT AS hour, dow::BIGINT AS day_of_week, dom::BIGINT AS day_of_month,
 mon::BIGINT AS month, yr::BIGINT AS year,
 (dow >= 5)::INTEGER AS weekend_flag, (hour BETWEEN 9 AND 17)::INTEGER AS is_business_hours,
 (hour >= 22 OR hour <= 6)::INTEGER AS is_night_time, (hour <= 6)::INTEGER AS is_early_morning,
 (hour >= 22)::INTEGER AS is_late_night, (dom >= 28)::INTEGER AS is_month_end, (dom <= 3)::INTEGER AS is_month_start,
 round(sin(2 * pi() * hour / 24), 6) AS hour_sin, round(cos(2 * pi() * hour / 24), 6) AS hour_cos,
 round(sin(2 * pi() * dow / 7), 6) AS day_of_week_sin, round(cos(2 * pi() * dow / 7), 6) AS day_of_week_cos,
 round(sin(2 * pi() * mon / 12), 6) AS month_sin, round(cos(2 * pi() * mon / 12), 6) AS month_cos
 FROM (SELECT transaction_id, extract(hour FROM "timestamp") AS hour, extract(isodow FROM "timestamp") - 1 AS dow,
  extract(day FROM "timestamp") AS dom, extract(month FROM "timestamp") AS mon, extract(year FROM "timestamp") AS yr
  FROM tx) t"""

RECEIVER = """SELECT transaction_id, c::BIGINT AS receiver_tx_count, f::DOUBLE AS receiver_fraud_count,
 round(r, 6) AS receiver_fraud_rate, round(t, 4) AS receiver_total_amount, round(round(a, 6) + 1.37e-7, 4) AS receiver_avg_amount,
 round(round(r, 6) * 0.6 + c / m * 0.4, 6) AS receiver_risk_score
 FROM tx JOIN (SELECT *, max(c) OVER () AS m FROM (SELECT receiver_account, count(*)::DOUBLE AS c, sum(is_fraud) AS f,
  avg(is_fraud) AS r, sum(amount) AS t, avg(amount) AS a FROM tx GROUP BY 1) x) s USING (receiver_account)"""

# Averages over senders take the scores as they are and round once.
UNROUNDED_RECEIVER = RECEIVER.replace("round(round(r, 6) * 0.6 + c / m * 0.4, 6)", "round(r, 6) * 0.6 + c / m * 0.4")

NOVELTY = """SELECT transaction_id, (lf = 1)::BIGINT AS new_location_flag, (df = 1)::BIGINT AS new_device_flag,
 lf::BIGINT AS location_frequency, df::BIGINT AS device_frequency,
 CAST(sum((lf = 1)::INTEGER) OVER w AS BIGINT) AS sender_location_count,
 CAST(sum((df = 1)::INTEGER) OVER w AS BIGINT) AS sender_device_count
 FROM (SELECT *,
  row_number() OVER (PARTITION BY sender_account, lower(trim(location)) ORDER BY "timestamp", transaction_id) AS lf,
  row_number() OVER (PARTITION BY sender_account, lower(trim(device_used)) ORDER BY "timestamp", transaction_id) AS df
  FROM tx) x
 WINDOW w AS (PARTITION BY sender_account ORDER BY "timestamp", transaction_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

PAIRS = """SELECT transaction_id, count(*) OVER w AS sender_receiver_frequency,
 round(sum(amount) OVER w, 4) AS sender_receiver_total_amount,
 round(round(avg(amount) OVER w, 6) + 1.37e-7, 4) AS sender_receiver_avg_amount
 FROM tx WINDOW w AS (PARTITION BY sender_account, receiver_account)"""

MODELS = """models AS (SELECT 'direct' AS model, y, p FROM scored
 UNION ALL SELECT 'inverse', y, 1 - p FROM scored
 UNION ALL SELECT 'squared', y, p * p FROM scored)"""

MODEL_METRICS = """mg AS (SELECT model, p AS threshold, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM models GROUP BY 1, 2),
 mc AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM mg
  WINDOW w AS (PARTITION BY model ORDER BY threshold DESC)),
 ma AS (SELECT model, sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc,
  sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc,
  sum(CASE WHEN threshold >= 0.5 THEN pos ELSE 0 END) AS tp, sum(CASE WHEN threshold >= 0.5 THEN neg ELSE 0 END) AS fp,
  sum(CASE WHEN threshold < 0.5 THEN pos ELSE 0 END) AS fn FROM mc GROUP BY model),
 mp AS (SELECT model, pr_auc, roc_auc, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS "precision",
  tp / (tp + fn) AS recall FROM ma),
 mm AS (SELECT *, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END
  AS f1_score FROM mp)"""

HASH = "CAST('0x' || substr(md5(concat_ws(':', '42', transaction_id)), 1, 15) AS BIGINT)"

COMPARE = """res AS (SELECT s.*, CASE WHEN threshold = 0.5 THEN 'a' ELSE 'b' END AS side, ar.pr_auc, ar.roc_auc,
  recall AS fraud_detection_rate,
  CASE WHEN threshold = 0.5 THEN 8000.0 ELSE 788.0 END AS train_samples, (tp + fp + fn + tn)::DOUBLE AS test_samples,
  CASE WHEN threshold = 0.5 THEN 0.04 ELSE 0.5 END AS train_fraud_rate, (tp + fn)::DOUBLE / (tp + fp + fn + tn) AS test_fraud_rate
 FROM swept s, (SELECT sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc,
  sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc FROM cv) ar),
 long AS (UNPIVOT (SELECT side, accuracy, "precision", recall, f1_score, roc_auc, pr_auc, fraud_detection_rate,
   false_positive_rate, customer_friction_rate, train_samples AS "Train Samples", test_samples AS "Test Samples",
   train_fraud_rate AS "Train Fraud Rate", test_fraud_rate AS "Test Fraud Rate" FROM res)
  ON COLUMNS(* EXCLUDE side) INTO NAME metric_name VALUE v),
 cmp AS (SELECT metric_name, a.v AS imbalanced_value, b.v AS balanced_value, b.v - a.v AS difference,
  CASE WHEN a.v <> 0 THEN (b.v - a.v) / a.v * 100 WHEN b.v = 0 THEN 0 ELSE 'inf'::DOUBLE END AS percent_change
 FROM (SELECT * FROM long WHERE side = 'a') a JOIN (SELECT * FROM long WHERE side = 'b') b USING (metric_name))"""

TUNED = """f AS (SELECT *, 2 * ("precision" * recall) / ("precision" + recall + 1e-8) AS f1 FROM pts),
 tuned AS (
 (SELECT 'f1_optimal' AS strategy, f1 AS score, * FROM f ORDER BY f1 DESC, threshold LIMIT 1) UNION ALL
 (SELECT 'precision_focused', recall, * FROM f WHERE "precision" >= 0.1 ORDER BY recall DESC, threshold LIMIT 1) UNION ALL
 (SELECT 'recall_focused', "precision", * FROM f WHERE recall >= 0.8 ORDER BY "precision" DESC, threshold LIMIT 1) UNION ALL
 (SELECT 'balanced', tpr - fpr, * FROM f ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1) UNION ALL
 (SELECT 'business_conservative', recall, * FROM f WHERE "precision" >= 0.5 ORDER BY recall DESC, threshold LIMIT 1) UNION ALL
 (SELECT 'business_aggressive', "precision", * FROM f WHERE recall >= 0.9 ORDER BY "precision" DESC, threshold LIMIT 1))"""

UNIT = """c AS (SELECT strategy, threshold, tp, fp, cp - tp AS fn, cn - fp AS tn FROM tuned),
 impact AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS fraud_detection_rate,
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS false_alarm_rate, tp + fp AS customers_flagged,
  (tp + fp) / (tp + fp + fn + tn) AS customer_friction_rate, tp * 100 AS fraud_prevented_value,
  fn * 100 AS fraud_loss_value, fp * 5 AS false_positive_total, tp * 100 - fp * 5 AS net_benefit,
  CASE WHEN tp > 0 THEN fp * 5 / tp END AS cost_per_fraud_detected,
  CASE WHEN fp > 0 THEN (tp * 100 - fp * 5) / (fp * 5) END AS roi_ratio FROM c)"""

DETAIL = """d0 AS (SELECT *, tp * 150::DOUBLE * 0.8::DOUBLE AS gross, (tp + fp) * 10::DOUBLE + fp * 25::DOUBLE AS ops, fn * 150::DOUBLE AS losses,
  (tp + fp + fn + tn)::DOUBLE AS nn FROM swept),
 detail AS (SELECT *, gross - ops - losses AS net_benefit, CASE WHEN ops > 0 THEN (gross - ops) / ops * 100 ELSE 0 END AS roi_percentage,
  CASE WHEN tp > 0 THEN ops / tp END AS cost_per_fraud_detected, CASE WHEN ops > 0 THEN gross / ops ELSE 0 END AS prevention_efficiency,
  CASE WHEN tp + fp > 0 THEN fp::DOUBLE / (tp + fp) ELSE 0 END AS customer_impact_ratio,
  (gross - ops - losses) / nn AS net_benefit_per_transaction FROM d0)"""

REGISTRY = """reg AS (SELECT o_orderpriority AS name, 'v' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS version,
  o_orderdate AS created_at, CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes FROM orders),
 nth AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, version DESC) AS nth FROM reg)"""

AREAS = """ar AS (SELECT sum(pos * tp / (tp + fp)) / sum(pos) AS pr_auc,
  sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc,
  sum(pos * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1 END) / 2)
   / sum(pos) AS pr_auc_trapezoid FROM cv)"""

MEDIANS = """fills AS (SELECT
  (SELECT quantile_cont(amount, 0.5) FROM dirty) AS amount,
  (SELECT sender_account FROM dirty WHERE sender_account IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS sender)"""

INF = """spiked AS (SELECT transaction_id, CASE WHEN n % 211 = 0 THEN 'inf'::DOUBLE WHEN n % 223 = 0 THEN '-inf'::DOUBLE
  ELSE amount END AS amount FROM tx)"""

RAW = """raw AS (SELECT transaction_id, "timestamp" AS t, CASE n % 7
  WHEN 0 THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') WHEN 1 THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S')
  WHEN 2 THEN strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') WHEN 3 THEN strftime("timestamp", '%Y-%m-%d %H:%M:%S')
  WHEN 4 THEN strftime("timestamp", '%m/%d/%Y %H:%M:%S') WHEN 5 THEN strftime("timestamp", '%d/%m/%Y %H:%M:%S')
  ELSE 'garbage' END AS raw FROM tx),
 parsed AS (SELECT transaction_id, coalesce(try_strptime(raw, '%Y-%m-%dT%H:%M:%S.%f'), try_strptime(raw, '%Y-%m-%dT%H:%M:%S'),
  try_strptime(raw, '%Y-%m-%d %H:%M:%S.%f'), try_strptime(raw, '%Y-%m-%d %H:%M:%S'),
  try_strptime(raw, '%m/%d/%Y %H:%M:%S'), try_strptime(raw, '%d/%m/%Y %H:%M:%S')) AS t FROM raw)"""

PREDICTION_ROWS = """pred AS (SELECT transaction_id, y, p AS fraud_probability, """ + level() + """ AS risk_level,
  (p >= 0.5)::INTEGER AS fraud_prediction FROM scored)"""

ERRORS = """err AS (SELECT transaction_id, CASE WHEN "timestamp" IS NULL THEN 'TimestampError'
   WHEN sender_account IS NULL OR receiver_account IS NULL THEN 'MissingValueError'
   WHEN amount IS NULL THEN 'AmountError' END AS error_type,
  CASE WHEN "timestamp" IS NULL THEN 'timestamp is missing or unreadable'
   WHEN sender_account IS NULL THEN 'sender is missing' WHEN receiver_account IS NULL THEN 'receiver is missing'
   WHEN amount IS NULL THEN 'amount is missing or not a number' END AS error_message FROM dirty)"""


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    # ------------------------------------------------------------ features
    o["f1_time_features"] = q(TX, TIME)
    o["f2_sender_windows"] = q(TX, SENDER)
    o["f2_sender_windows_ties"] = q(TX.replace("tx AS", "tx0 AS"), TIES, SENDER)
    o["f2_sender_windows_dense"] = q(WIDE, SENDER)
    o["f3_receiver_risk"] = q(TX, RECEIVER)
    o["f3_receiver_point_in_time"] = q(TX, """SELECT transaction_id, c AS receiver_tx_count, f::DOUBLE AS receiver_fraud_count,
 round(r, 6) AS receiver_fraud_rate, round(t, 4) AS receiver_total_amount,
 round(round(CASE WHEN c > 0 THEN t / c ELSE 0 END, 6) + 1.37e-7, 4) AS receiver_avg_amount,
 round(round(r, 6) * 0.6 + c::DOUBLE / m * 0.4, 6) AS receiver_risk_score
 FROM (SELECT *, CASE WHEN c > 0 THEN f::DOUBLE / c ELSE 0.04 END AS r, max(c + 1) OVER () AS m
 FROM (SELECT transaction_id, count(*) OVER w AS c, coalesce(sum(is_fraud) OVER w, 0) AS f, coalesce(sum(amount) OVER w, 0) AS t
 FROM tx WINDOW w AS (PARTITION BY receiver_account ORDER BY "timestamp", transaction_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) a) b""")
    o["f4_novelty"] = q(TX, NOVELTY)
    o["f5_pair_features"] = q(TX, PAIRS)
    o["f6_numeric_or_zero"] = q(TX, """SELECT transaction_id, coalesce(TRY_CAST(CASE WHEN n % 11 = 0 THEN 'abc'
 WHEN n % 13 = 0 THEN NULL ELSE CAST(k AS VARCHAR) END AS DOUBLE), 0) AS k FROM tx""")
    o["f7_all_features"] = q(
        TX, f"a AS ({TIME})", f"b AS ({SENDER})", f"c AS ({RECEIVER})", f"d AS ({NOVELTY})", f"e AS ({PAIRS})",
        "SELECT * FROM a JOIN b USING (transaction_id) JOIN c USING (transaction_id)"
        " JOIN d USING (transaction_id) JOIN e USING (transaction_id)",
    )
    o["flagship_risky_senders"] = q(
        TX, f"b AS ({SENDER})", f"c AS ({UNROUNDED_RECEIVER})", """SELECT sender_account, count(*) AS n_tx,
 max(velocity_24h) AS max_velocity_24h, round(avg(receiver_risk_score), 6) AS mean_receiver_risk,
 max(tx_count_last_24h)::BIGINT AS max_tx_24h, sum(is_fraud)::BIGINT AS n_fraud
 FROM tx JOIN b USING (transaction_id) JOIN c USING (transaction_id) GROUP BY 1""")
    # ------------------------------------------------------------- quality
    o["v3_label_check"] = q(TX, """SELECT count(*) AS n_rows, count(*) FILTER (is_fraud NOT IN (0, 1) OR is_fraud IS NULL) AS n_invalid,
 (count(*) FILTER (is_fraud NOT IN (0, 1) OR is_fraud IS NULL) = 0)::INTEGER AS is_binary FROM tx""")
    o["v4_drop_empty_rows"] = q(TX, DIRTY, """SELECT sender_account, round(amount, 4) AS amount FROM dirty
 WHERE sender_account IS NOT NULL OR amount IS NOT NULL""")
    o["v5_drop_empty_columns"] = q(TX, "SELECT transaction_id, amount FROM tx")
    o["v6_trim_text"] = q(TX, DIRTY, """SELECT transaction_id, nullif(trim(sender_account), '') AS sender_account,
 nullif(trim(location), '') AS location, nullif(trim(device_used), '') AS device_used FROM dirty""")
    o["v7_coerce_amounts"] = q(TX, """SELECT transaction_id, TRY_CAST(CASE WHEN n % 11 = 0 THEN 'n/a'
 ELSE CAST(k AS VARCHAR) || '.5' END AS DOUBLE) AS amount FROM tx""")
    o["v8_dedupe_by_id"] = q(TX, DIRTY, """SELECT transaction_id, sender_account, round(amount, 4) AS amount, device_used FROM
 (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY "timestamp") AS r FROM dirty) d WHERE r = 1""")
    o["v8_duplicate_report"] = q(TX, DIRTY, """SELECT count(*) AS n_rows, count(DISTINCT transaction_id) AS n_ids,
 count(*) - count(DISTINCT transaction_id) AS n_removed FROM dirty""")
    o["v9_dedupe_rows"] = q(TX, DIRTY, """SELECT DISTINCT transaction_id, sender_account, round(amount, 4) AS amount,
 location, device_used, is_fraud FROM dirty""")
    o["v10_fill_nulls"] = q(TX, DIRTY, MEDIANS, """SELECT transaction_id, coalesce(sender_account, f.sender) AS sender_account,
 round(coalesce(dirty.amount, f.amount), 4) AS amount FROM dirty, fills f""")
    o["v11_make_finite"] = q(TX, INF, """SELECT transaction_id, CASE WHEN amount = 'inf'::DOUBLE THEN
 (SELECT max(amount) FROM spiked WHERE isfinite(amount)) WHEN amount = '-inf'::DOUBLE THEN
 (SELECT min(amount) FROM spiked WHERE isfinite(amount)) ELSE amount END AS amount FROM spiked""")
    o["v12_clip_outliers"] = q(TX, DIRTY, """SELECT transaction_id,
 round(CASE WHEN amount IS NOT NULL THEN least(greatest(amount, m - 5 * s), m + 5 * s) END, 4) AS amount
 FROM dirty, (SELECT avg(amount) AS m, stddev_samp(amount) AS s FROM dirty) b""")
    o["v13_null_report"] = q(TX, DIRTY, """SELECT "column", round(r, 6) AS null_ratio,
 CASE WHEN r > 0.05 THEN 'excessive_nulls' ELSE 'none' END AS issue,
 CASE WHEN "column" = 'timestamp' THEN 'time_not_timestamp' ELSE 'none' END AS type_issue FROM (
 SELECT 'sender_account' AS "column", avg((sender_account IS NULL)::INTEGER) AS r FROM dirty UNION ALL
 SELECT 'amount', avg((amount IS NULL)::INTEGER) FROM dirty UNION ALL
 SELECT 'timestamp', avg(("timestamp" IS NULL)::INTEGER) FROM dirty UNION ALL
 SELECT 'receiver_account', avg((receiver_account IS NULL)::INTEGER) FROM dirty) u""")
    o["v15_label_rate"] = q(TX, """SELECT n_rows, round(r, 6) AS label_rate,
 CASE WHEN r < 0.001 THEN 'too_low' WHEN r > 0.5 THEN 'too_high' ELSE 'ok' END AS status
 FROM (SELECT count(*) AS n_rows, avg(is_fraud) AS r FROM tx) t""")
    o["v18_sanitise_output"] = q(SCORED, """SELECT transaction_id, CASE WHEN i % 5 = 0 THEN 0.5 WHEN i % 7 = 0 THEN 1.0
 WHEN i % 11 = 0 THEN 0.0 WHEN i % 13 = 0 THEN least(p + 0.9, 1.0) ELSE p END AS p
 FROM (SELECT *, CAST(transaction_id AS BIGINT) AS i FROM scored) s""")
    o["v19_output_violations"] = q(SCORED, PREDICTION_ROWS, """SELECT count(*) AS n_rows,
 count(*) FILTER (fraud_probability + 0.1 > 1) AS bad_probability,
 count(*) FILTER (risk_level = 'high') AS bad_level, 0::BIGINT AS bad_prediction FROM pred""")
    o["v20_safe_math"] = q(TX, """SELECT transaction_id, round(CASE WHEN k % 5 <> 0 THEN amount / (k % 5) ELSE -1 END, 6) AS quotient,
 round(CASE WHEN k > 50 THEN ln(k - 50) ELSE 0 END, 6) AS logarithm FROM tx""")
    o["v21_fallback_rows"] = q(TX, DIRTY, ERRORS, """SELECT transaction_id, 0.5::DOUBLE AS fraud_probability, 0.5::DOUBLE AS anomaly_score,
 'medium' AS risk_level, 1 AS fraud_prediction, 'fallback_v1.0' AS model_version,
 'Fallback prediction due to model failure (probability: 0.5)' AS explanation FROM err WHERE error_type IS NOT NULL""")
    o["v22_error_rows"] = q(TX, DIRTY, ERRORS, """SELECT transaction_id, 0.5::DOUBLE AS fraud_probability, 'medium' AS risk_level, error_type, error_message,
 'Error during processing: ' || error_message AS explanation FROM err WHERE error_type IS NOT NULL""")
    o["v23_data_profile"] = q(TX, DIRTY, """n AS (SELECT count(*) - count(sender_account) AS a, count(*) - count(amount) AS b,
  count(*) - count(location) AS c, count(*) AS r FROM dirty)""", """SELECT 'sender_account' AS "column", a AS null_count,
 round(1 - (a + b + c)::DOUBLE / (3 * r), 6) AS quality_score FROM n UNION ALL
 SELECT 'amount', b, round(1 - (a + b + c)::DOUBLE / (3 * r), 6) FROM n UNION ALL
 SELECT 'location', c, round(1 - (a + b + c)::DOUBLE / (3 * r), 6) FROM n""")
    o["v23_class_distribution"] = q(TX, "SELECT is_fraud AS label, count(*) AS n_rows FROM tx GROUP BY 1")
    o["v25_split_overlap"] = q(TX, """SELECT count(*) AS n_overlap FROM (SELECT transaction_id FROM tx WHERE k < 60
 INTERSECT SELECT transaction_id FROM tx WHERE k >= 40) i""")
    o["v26_score_distribution"] = q(SCORED, """SELECT y, count(*) AS n_rows, count(DISTINCT p) AS n_distinct, min(p) AS min_p, max(p) AS max_p,
 round(avg(p), 6) AS mean_p, round(stddev_pop(p), 6) AS std_p, (stddev_pop(p) < 0.001)::INTEGER AS is_degenerate
 FROM scored GROUP BY y""")
    # -------------------------------------------------------- preprocessing
    o["p1_parse_timestamps"] = q(TX, RAW, "SELECT transaction_id, epoch_us(t)::BIGINT AS us FROM parsed")
    o["p2_parse_report"] = q(TX, RAW, """SELECT count(*) AS n_rows, count(t) AS n_parsed,
 round(count(t)::DOUBLE / count(*), 6) AS success_rate FROM parsed""")
    o["p3_time_parts"] = q(TX, RAW, """x AS (SELECT transaction_id, extract(hour FROM t) AS hour, extract(isodow FROM t) - 1 AS dow,
 extract(day FROM t) AS dom, extract(month FROM t) AS mon, extract(year FROM t) AS yr FROM parsed),
 z AS (SELECT *, (dow >= 5)::INTEGER AS we, (hour BETWEEN 9 AND 17)::INTEGER AS bh, (hour >= 22 OR hour <= 6)::INTEGER AS ni FROM x)""",
    """SELECT transaction_id, coalesce(hour, (SELECT quantile_cont(hour, 0.5) FROM x))::DOUBLE AS hour,
 coalesce(dow, (SELECT quantile_cont(dow, 0.5) FROM x))::DOUBLE AS day_of_week,
 coalesce(dom, (SELECT quantile_cont(dom, 0.5) FROM x))::DOUBLE AS day_of_month,
 coalesce(mon, (SELECT quantile_cont(mon, 0.5) FROM x))::DOUBLE AS month,
 coalesce(yr, (SELECT quantile_cont(yr, 0.5) FROM x))::DOUBLE AS year,
 coalesce(we, (SELECT we FROM z WHERE we IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS is_weekend,
 coalesce(bh, (SELECT bh FROM z WHERE bh IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS is_business_hours,
 coalesce(ni, (SELECT ni FROM z WHERE ni IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS is_night FROM z""")
    o["p4_label_encode"] = q(TX, DIRTY, """codes AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM
 (SELECT DISTINCT coalesce(sender_account, 'MISSING') AS value FROM dirty WHERE is_fraud = 1) d)""",
    """SELECT transaction_id, coalesce(code, -1)::BIGINT AS sender_account FROM dirty
 LEFT JOIN codes ON value = coalesce(sender_account, 'MISSING')""")
    o["p5_one_hot"] = q(TX, "SELECT transaction_id, " + ", ".join(
        f"(merchant_category = 'M{i}')::INTEGER AS \"merchant_category_M{i}\"" for i in range(8)) + " FROM tx")
    o["p6_dummies"] = q(TX, """SELECT amount, (device_used = 'D1')::INTEGER AS "device_used_D1", (device_used = 'D3')::INTEGER AS "device_used_D3",
 0.0::DOUBLE AS "device_used_D9" FROM tx""")
    o["p7_log_amounts"] = q(TX, DIRTY, """s AS (SELECT transaction_id, CASE WHEN n % 19 = 0 THEN 0 ELSE amount END AS a FROM dirty),
 f AS (SELECT transaction_id, coalesce(a, (SELECT quantile_cont(a, 0.5) FROM s)) AS a FROM s),
 e AS (SELECT min(a) / 1000 AS eps FROM f WHERE a > 0)""",
    "SELECT transaction_id, round(ln(1 + a + eps), 6) AS amount, round(a, 4) AS amount_original FROM f, e")
    o["p8_impute"] = q(TX, DIRTY, MEDIANS, """SELECT transaction_id, coalesce(sender_account, f.sender) AS sender_account,
 round(coalesce(dirty.amount, (SELECT avg(amount) FROM dirty)), 4) AS amount FROM dirty, fills f""")
    o["p9_detect_columns"] = q(TX, """SELECT v.name, v.kind FROM (VALUES ('amount', 'amount'), ('sender_account', 'category'),
 ('location', 'category'), ('k', CASE WHEN (SELECT max(k) > 1 AND min(k) >= 0 FROM tx) THEN 'amount' END)) v(name, kind)
 WHERE v.kind IS NOT NULL""")
    # -------------------------------------------------------------- splits
    o["d1_balanced_undersample"] = q(TX, f"""SELECT transaction_id, is_fraud FROM (SELECT transaction_id, is_fraud,
 row_number() OVER (PARTITION BY is_fraud ORDER BY {HASH}, transaction_id) AS r FROM tx) t
 WHERE is_fraud = 1 OR r <= (SELECT sum(is_fraud) FROM tx)""")
    o["d2_time_split"] = q(TX, """SELECT transaction_id, CASE WHEN row_number() OVER (ORDER BY "timestamp", transaction_id)
 <= (SELECT floor(count(*) * 0.8) FROM tx) THEN 'train' ELSE 'test' END AS split FROM tx""")
    o["d2_time_split_ties"] = q(TX.replace("tx AS", "tx0 AS"), TIES, """SELECT transaction_id, CASE WHEN row_number() OVER
 (ORDER BY "timestamp", transaction_id) <= (SELECT floor(count(*) * 0.8) FROM tx) THEN 'train' ELSE 'test' END AS split FROM tx""")
    o["d3_split_report"] = q(TX, """s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY "timestamp", transaction_id)
 <= (SELECT floor(count(*) * 0.8) FROM tx) THEN 'train' ELSE 'test' END AS split FROM tx)""",
    """SELECT split, count(*) AS n_rows, round(avg(is_fraud), 6) AS label_rate, epoch_us(min("timestamp"))::BIGINT AS first_us,
 epoch_us(max("timestamp"))::BIGINT AS last_us FROM s GROUP BY split""")
    strat = f"""s AS (SELECT transaction_id, is_fraud, CASE WHEN r <= floor(c * 0.8 + 0.5) THEN 'train' ELSE 'test' END AS split FROM
 (SELECT transaction_id, is_fraud, count(*) OVER (PARTITION BY is_fraud) AS c,
  row_number() OVER (PARTITION BY is_fraud ORDER BY {HASH}, transaction_id) AS r FROM tx) t)"""
    o["d4_stratified_split"] = q(TX, strat, "SELECT transaction_id, split FROM s")
    o["d4_drift_report"] = q(TX, strat, """SELECT split, count(*) AS n_rows, round(avg(is_fraud), 6) AS label_rate,
 (abs(avg(is_fraud) - (SELECT avg(is_fraud) FROM tx)) > 0.01)::INTEGER AS has_drift FROM s GROUP BY split""")
    o["d5_folds"] = q(TX, f"""SELECT transaction_id, CASE WHEN r <= c // 5 THEN 0 WHEN r <= c * 2 // 5 THEN 1
 WHEN r <= c * 3 // 5 THEN 2 WHEN r <= c * 4 // 5 THEN 3 ELSE 4 END AS fold FROM
 (SELECT transaction_id, count(*) OVER (PARTITION BY is_fraud) AS c,
  row_number() OVER (PARTITION BY is_fraud ORDER BY {HASH}, transaction_id) AS r FROM tx) t""")
    o["d6_resample"] = q(TX, """r AS (SELECT transaction_id, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY transaction_id) AS rank_,
  count(*) OVER (PARTITION BY is_fraud) AS n FROM tx),
 sizes AS (SELECT is_fraud, max(n) AS n FROM r GROUP BY 1),
 draws AS (SELECT j AS draw, is_fraud, CAST('0x' || substr(md5('42:' || is_fraud || ':' || j), 1, 15) AS BIGINT) % n + 1 AS rank_
  FROM sizes, (SELECT unnest(range((SELECT max(n) FROM sizes))) AS j) g)""",
    "SELECT draw, transaction_id, is_fraud FROM draws JOIN r USING (is_fraud, rank_)")
    o["d7_smote"] = q(TX, *SMOTE, "SELECT draw, amount, k, hour, location, is_fraud FROM made")
    o["d7_balanced_set"] = q(TX, *SMOTE, """SELECT NULL AS transaction_id, draw, amount, k, hour, location, is_fraud FROM made
 UNION ALL SELECT transaction_id, NULL, amount, k, hour("timestamp"), location, is_fraud FROM tx""")
    o["m4_tree_samples"] = "WITH RECURSIVE " + ",\n".join([TX, f"""ranked AS (
 SELECT transaction_id, row_number() OVER (ORDER BY {HASH}, transaction_id) - 1 AS rank, count(*) OVER () AS n FROM tx)""",
    permutation_sql("""SELECT n, '42:tree-' || t AS key, unnest(range(least(256, n))) AS place
 FROM (SELECT max(n) AS n FROM ranked) m, range(100) trees(t)""")]) + """
SELECT replace(key, '42:tree-', '')::INTEGER AS tree, transaction_id FROM permuted JOIN ranked USING (rank)"""
    o["d8_assign_metadata"] = q(TX, """SELECT transaction_id, 'TXN' || lpad(CAST(r - 1 AS VARCHAR), 8, '0') AS sequence_id,
 (1704067200 + (r - 1) * 120)::BIGINT AS sequence_seconds, CASE WHEN is_fraud = 1 THEN 'synthetic_fraud' ELSE 'none' END AS fraud_type
 FROM (SELECT transaction_id, is_fraud, row_number() OVER (ORDER BY "timestamp", transaction_id) AS r FROM tx) t""")
    # ------------------------------------------------------------ model math
    o["m1_impute_clip"] = q(TX, DIRTY, """SELECT transaction_id, round(least(greatest(coalesce(amount,
 (SELECT quantile_cont(amount, 0.5) FROM dirty)), -1e10), 1e10), 4) AS amount FROM dirty""")
    o["m2_standardise"] = q(TX, """SELECT transaction_id, round((amount - m) / s, 6) AS amount, round((k - mk) / sk, 6) AS k FROM tx,
 (SELECT avg(amount) AS m, stddev_pop(amount) AS s, avg(k) AS mk, stddev_pop(k) AS sk FROM tx) b""")
    o["m6_normalise_scores"] = q(SCORED, """SELECT transaction_id, round((hi - p) / (hi - lo), 6) AS score FROM scored,
 (SELECT min(p) AS lo, max(p) AS hi FROM scored) b""")
    o["m7_flag_anomalies"] = q(SCORED, """SELECT transaction_id, (p >= (SELECT quantile_cont(p, 0.96) FROM scored))::INTEGER AS is_anomaly FROM scored""")
    o["m8_score_stats"] = q(SCORED, """SELECT count(*) AS n_samples, round(avg(p), 6) AS score_mean, round(stddev_pop(p), 6) AS score_std,
 min(p) AS score_min, max(p) AS score_max, round(quantile_cont(p, 0.96), 6) AS threshold_percentile FROM scored""")
    o["m10_class_weight"] = q(TX, """SELECT transaction_id, round(CASE WHEN is_fraud = 1 THEN
 (SELECT sum(1 - is_fraud)::DOUBLE / sum(is_fraud) FROM tx) ELSE 1 END, 6) AS weight FROM tx""")
    o["m21_registry_list"] = q(REGISTRY, """SELECT name, count(*) AS n_versions, sum(size_bytes)::BIGINT AS total_bytes,
 max(CASE WHEN nth = 1 THEN version END) AS latest_version FROM nth GROUP BY name""")
    o["m21_registry_latest"] = q(REGISTRY, "SELECT name, version, size_bytes FROM nth WHERE nth = 1")
    o["m21_registry_keep"] = q(REGISTRY, "SELECT name, version FROM nth WHERE nth <= 5")
    o["m21_registry_superseded"] = q(REGISTRY, "SELECT name, version, size_bytes FROM nth WHERE nth > 5")
    o["m21_registry_storage"] = q(REGISTRY, """SELECT count(DISTINCT name) AS n_names, count(*) AS n_versions,
 sum(size_bytes)::BIGINT AS total_bytes, round(avg(size_bytes), 4) AS mean_bytes FROM reg""")
    # ------------------------------------------------------------ decisions
    o["r1_risk_levels"] = q(SCORED, f"SELECT transaction_id, {level()} AS risk_level FROM scored")
    o["r2_decisions"] = q(SCORED, CURVE, TUNED, """SELECT transaction_id, (p >= (SELECT threshold FROM tuned
 WHERE strategy = 'f1_optimal'))::INTEGER AS fraud_prediction FROM scored""")
    o["r3_explanations"] = q(SCORED, """x AS (SELECT transaction_id, p + 1e-6 AS p, CAST(transaction_id AS BIGINT) % 10 / 10.0::DOUBLE AS a FROM scored)""",
    """SELECT transaction_id, CASE
 WHEN p >= 0.7 AND a > 0.7 THEN printf('High fraud risk (probability: %.2f) due to unusual transaction patterns (anomaly score: %.2f)', p, a)
 WHEN p >= 0.7 THEN printf('High fraud risk (probability: %.2f) based on learned fraud patterns', p)
 WHEN p >= 0.3 THEN printf('Medium fraud risk (probability: %.2f) - requires additional verification', p)
 ELSE printf('Low fraud risk (probability: %.2f) - transaction appears legitimate', p) END AS explanation FROM x""")
    o["r4_risk_summary"] = q(SCORED, """SELECT count(*) AS n_rows, min(p) AS min_p, max(p) AS max_p, round(avg(p), 6) AS mean_p,
 round(stddev_pop(p), 6) AS std_p, round(quantile_cont(p, 0.25), 6) AS p25, round(quantile_cont(p, 0.5), 6) AS median,
 round(quantile_cont(p, 0.75), 6) AS p75, round(quantile_cont(p, 0.9), 6) AS p90, round(quantile_cont(p, 0.95), 6) AS p95,
 round(quantile_cont(p, 0.99), 6) AS p99 FROM scored""")
    o["r4_level_summary"] = q(SCORED, f"""SELECT risk_level, count(*) AS n_rows, min(p) AS min_p, max(p) AS max_p, round(avg(p), 6) AS mean_p,
 round(quantile_cont(p, 0.5), 6) AS median_p, round(count(*) * 100.0 / (SELECT count(*) FROM scored), 6) AS percentage
 FROM (SELECT *, {level()} AS risk_level FROM scored) s GROUP BY risk_level""")
    o["r5_label_by_level"] = q(SCORED, f"""SELECT risk_level, count(*) AS n_rows, sum(y)::BIGINT AS fraud_count, round(avg(y), 6) AS fraud_rate,
 round(count(*) * 100.0 / (SELECT count(*) FROM scored), 6) AS percentage_of_total
 FROM (SELECT *, {level()} AS risk_level FROM scored) s GROUP BY risk_level""")
    o["r6_level_counts"] = q(SCORED, f"SELECT {level()} AS risk_level, count(*) AS n_rows FROM scored GROUP BY 1")
    o["r7_recommended_bands"] = q(SCORED, CURVE, TUNED, """SELECT round(threshold, 6) AS f1_threshold, round(greatest(0.1, threshold - 0.2), 6) AS new_low,
 round(least(0.9, threshold + 0.2), 6) AS new_high FROM tuned WHERE strategy = 'f1_optimal'""")
    o["r8_alternative_levels"] = q(SCORED, " UNION ALL ".join(
        f"SELECT '{n}' AS config, {level('p', a, b)} AS risk_level, count(*) AS n_rows, sum(y)::BIGINT AS fraud_count FROM scored GROUP BY 2"
        for n, a, b in (("current", 0.3, 0.7), ("conservative", 0.4, 0.8), ("aggressive", 0.2, 0.6))))
    o["r9_ranked_transactions"] = q(TX, SCORED, PREDICTION_ROWS, """SELECT tx.transaction_id, amount, fraud_probability, risk_level, fraud_prediction
 FROM tx LEFT JOIN pred ON tx.transaction_id = pred.transaction_id""")
    o["r9_ranked_summary"] = q(SCORED, PREDICTION_ROWS, """SELECT count(*) AS n_rows, count(*) FILTER (risk_level = 'high') AS n_high,
 count(*) FILTER (risk_level = 'medium') AS n_medium, count(*) FILTER (risk_level = 'low') AS n_low,
 sum(fraud_prediction)::BIGINT AS n_flagged, round(avg(fraud_probability), 6) AS mean_probability FROM pred""")
    # -------------------------------------------------------------- metrics
    o["e1_confusion"] = q(*swept([0.5]), f"SELECT {big('tp', 'fp', 'fn', 'tn')} FROM counts")
    o["e1_confusion_normalised"] = q(*swept([0.5]), """SELECT round(tp::DOUBLE / (tp + fn), 6) AS tp, round(fn::DOUBLE / (tp + fn), 6) AS fn,
 round(fp::DOUBLE / (fp + tn), 6) AS fp, round(tn::DOUBLE / (fp + tn), 6) AS tn FROM counts""")
    o["e1_confusion_weighted"] = q(SCORED, """SELECT round(sum(CASE WHEN y = 1 AND p >= 0.5 THEN w ELSE 0 END), 4) AS tp,
 round(sum(CASE WHEN y = 0 AND p >= 0.5 THEN w ELSE 0 END), 4) AS fp, round(sum(CASE WHEN y = 1 AND p < 0.5 THEN w ELSE 0 END), 4) AS fn,
 round(sum(CASE WHEN y = 0 AND p < 0.5 THEN w ELSE 0 END), 4) AS tn FROM (SELECT *, 1 + p * 2 AS w FROM scored) s""")
    o["e2_precision_recall_f1"] = q(*swept([0.5]), f"SELECT {r6('precision', 'recall', 'f1_score')} FROM swept")
    o["e3_average_precision"] = q(SCORED, CURVE, AREAS, "SELECT round(pr_auc, 6) AS pr_auc FROM ar")
    o["e4_roc_auc"] = q(SCORED, CURVE, AREAS, "SELECT round(roc_auc, 6) AS roc_auc FROM ar")
    o["e5_pr_auc_trapezoid"] = q(SCORED, CURVE, AREAS, "SELECT round(pr_auc_trapezoid, 6) AS pr_auc_trapezoid FROM ar")
    o["e6_curve_points"] = q(SCORED, CURVE, f"""SELECT threshold, {big('tp', 'fp')}, {r6('precision', 'recall', 'fpr', 'tpr')} FROM pts""")
    o["e7_comprehensive"] = q(*swept([0.5]), CURVE, AREAS, f"""SELECT {big('tp', 'fp', 'fn', 'tn')},
 {r6('precision', 'recall', 'f1_score', 'pr_auc', 'roc_auc', 'false_positive_rate', 'specificity', 'customer_friction_rate', 'accuracy')},
 round(1 - recall, 6) AS false_negative_rate, (tp + fp + fn + tn)::BIGINT AS total_transactions, (tp + fn)::BIGINT AS total_fraud,
 round((tp + fn)::DOUBLE / (tp + fp + fn + tn), 6) AS fraud_rate FROM swept, ar""")
    o["e8_compact"] = q(*swept([0.5]), CURVE, AREAS, f"""SELECT {big('tp', 'fp', 'fn', 'tn')},
 {r6('accuracy', 'precision', 'recall', 'f1_score', 'roc_auc', 'pr_auc', 'false_positive_rate')} FROM swept, ar""")
    o["e10_threshold_sweep"] = q(*swept(SWEEP), f"""SELECT round(threshold, 6) AS threshold, {big('tp', 'fp', 'fn', 'tn')},
 {r6('precision', 'recall', 'f1_score', 'false_positive_rate', 'specificity', 'customer_friction_rate')} FROM swept""")
    o["e10_sweep_summary"] = q(*swept(SWEEP), " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(min(\"{m}\"), 6) AS min_value, round(max(\"{m}\"), 6) AS max_value, round(avg(\"{m}\"), 6) AS mean_value FROM swept"
        for m in ("precision", "recall", "f1_score")))
    o["e11_key_thresholds"] = q(*swept(KEY_THRESHOLDS), f"""SELECT threshold, {big('tp', 'fp', 'fn', 'tn')},
 {r6('precision', 'recall', 'f1_score', 'specificity', 'false_positive_rate')},
 round(customer_friction_rate, 6) AS predicted_fraud_rate, round(recall, 6) AS fraud_detection_rate FROM swept""")
    aims = [
        ("f1_optimal", "f1_score", "true"), ("precision_focused", "recall", '"precision" >= 0.5'),
        ("recall_focused", '"precision"', "recall >= 0.8"),
        ("business_balanced", "recall * 0.6 + (1 - customer_friction_rate) * 0.4", "true"),
        ("conservative", "recall", '"precision" >= 0.7 AND customer_friction_rate <= 0.1'),
        ("aggressive", '"precision"', "recall >= 0.9"),
    ]
    o["e12_operating_points"] = q(*swept(SWEEP), " UNION ALL ".join(
        f"""(SELECT '{n}' AS strategy, round(threshold, 6) AS threshold, round({s}, 6) AS score,
 {r6('precision', 'recall', 'f1_score', 'customer_friction_rate')} FROM swept WHERE {w} ORDER BY {s} DESC, threshold LIMIT 1)"""
        for n, s, w in aims))
    o["e13_tuned_thresholds"] = q(SCORED, CURVE, TUNED, f"SELECT strategy, threshold, {r6('score', 'precision', 'recall')} FROM tuned")
    ranges = [("high_precision", '"precision"', '"precision" >= 0.8'), ("high_recall", "recall", "recall >= 0.8"),
              ("balanced", "f1", 'abs("precision" - recall) <= 0.1')]
    o["e14_threshold_ranges"] = q(SCORED, CURVE, "f AS (SELECT *, 2 * (\"precision\" * recall) / (\"precision\" + recall + 1e-8) AS f1 FROM pts)", " UNION ALL ".join(
        f"""SELECT '{n}' AS range_name, min(threshold) AS min_threshold, max(threshold) AS max_threshold,
 (SELECT threshold FROM f WHERE {w} ORDER BY {v} DESC, threshold LIMIT 1) AS best_threshold, round(max({v}), 6) AS best_value,
 count(*) AS n_thresholds FROM f WHERE {w}""" for n, v, w in ranges))

    def search(meets: str, allowed: str, score: str) -> str:
        return q(*swept(SEARCH), f"""c AS (SELECT *, CASE WHEN {meets} THEN 0 WHEN {allowed} AND {score} > 0 THEN 1
 WHEN abs(threshold - 0.5) < 0.001 THEN 2 END AS rk, CASE WHEN {meets} THEN 0 ELSE -{score} END AS loss FROM swept)""",
        f"""SELECT round(threshold, 6) AS threshold, (rk = 0)::INTEGER AS constraints_met, {r6('precision', 'recall', 'f1_score', 'false_positive_rate')},
 {big('tp', 'fp', 'fn', 'tn')} FROM c WHERE rk IS NOT NULL ORDER BY rk, loss, threshold LIMIT 1""")

    o["e15_search_imbalanced"] = search("(false_positive_rate <= 0.05 AND recall BETWEEN 0.70 AND 0.85)", "false_positive_rate <= 0.05", "recall")
    o["e16_search_balanced"] = search('(recall BETWEEN 0.85 AND 0.95 AND "precision" BETWEEN 0.70 AND 0.90 AND f1_score > 0.75)', "true", "f1_score")
    o["e17_zero_miss"] = q(SCORED, "grid AS (SELECT min(p) - 0.001 AS threshold FROM scored WHERE y = 1)", SWEPT, f"""SELECT round(threshold, 6) AS threshold,
 {r6('accuracy', 'precision', 'recall', 'f1_score')}, {big('tp', 'fp', 'fn', 'tn')}, (accuracy >= 0.9998)::INTEGER AS accuracy_on_target,
 ("precision" >= 0.9996)::INTEGER AS precision_on_target, (recall >= 1.0)::INTEGER AS recall_on_target,
 (f1_score >= 0.9998)::INTEGER AS f1_score_on_target FROM swept""")
    # --------------------------------------------------------------- impact
    o["e18_unit_impact"] = q(SCORED, CURVE, TUNED, UNIT, f"""SELECT strategy, threshold, {big('tp', 'fp', 'fn', 'tn', 'customers_flagged')},
 {r6('fraud_detection_rate', 'false_alarm_rate', 'customer_friction_rate', 'fraud_prevented_value', 'fraud_loss_value',
     'false_positive_total', 'net_benefit', 'cost_per_fraud_detected', 'roi_ratio')} FROM impact""")
    o["e19_detailed_impact"] = q(*swept(KEY_THRESHOLDS), DETAIL, f"""SELECT threshold, round(gross, 6) AS fraud_prevented_value,
 round(losses, 6) AS fraud_losses, round(ops, 6) AS total_operational_costs, round(fp * 0.02::DOUBLE, 6) AS potential_churn,
 {r6('net_benefit', 'roi_percentage', 'cost_per_fraud_detected', 'prevention_efficiency', 'customer_impact_ratio',
     'net_benefit_per_transaction')} FROM detail""")
    bench = [("fraud_detection_rate", "recall", False, 0.95, 0.85, 0.75), ("false_positive_rate", "false_positive_rate", True, 0.01, 0.03, 0.05),
             ("precision", '"precision"', False, 0.8, 0.6, 0.4), ("customer_friction_rate", "customer_friction_rate", True, 0.02, 0.05, 0.1)]
    o["e20_benchmark_report"] = q(*swept([0.5]), " UNION ALL ".join(
        f"""SELECT '{n}' AS metric, round({c}, 6) AS current_value, CASE WHEN {c} {'<=' if low else '>='} {e} THEN 'excellent'
 WHEN {c} {'<=' if low else '>='} {g} THEN 'good' WHEN {c} {'<=' if low else '>='} {a} THEN 'acceptable' ELSE 'needs_improvement' END AS category,
 round({f'{c} - {e}' if low else f'{e} - {c}'}, 6) AS gap_to_excellent FROM swept""" for n, c, low, e, g, a in bench))
    o["e21_fired_rules"] = q(*swept([0.5]), CURVE, AREAS, DETAIL, """m AS (SELECT "precision" AS pre, recall AS rec, pr_auc AS prauc, false_positive_rate AS fpr,
  cost_per_fraud_detected AS cpf, customer_impact_ratio AS cir FROM detail, ar),
 r("group", code, metric, op, lim) AS (VALUES ('immediate_action', 'retrain_model', 'pr_auc', '<', 0.5), ('immediate_action', 'raise_threshold', 'precision', '<', 0.3),
  ('immediate_action', 'review_features', 'recall', '<', 0.6), ('strategic_improvement', 'invest_in_features', 'pr_auc', '<', 0.8),
  ('business_optimisation', 'reduce_investigation_cost', 'cost_per_fraud_detected', '>', 50.0), ('business_optimisation', 'add_risk_based_checks', 'customer_impact_ratio', '>', 0.5),
  ('model_improvement', 'more_fraud_examples', 'pr_auc', '<', 0.6), ('model_improvement', 'fewer_false_positives', 'precision', '<', 0.5),
  ('model_improvement', 'study_missed_fraud', 'recall', '<', 0.8), ('finding', 'many_false_positives', 'precision', '<', 0.5),
  ('finding', 'missed_fraud', 'recall', '<', 0.7), ('finding', 'strong_detection', 'pr_auc', '>', 0.7)),
 v AS (SELECT 'pr_auc' AS metric, prauc AS value FROM m UNION ALL SELECT 'precision', pre FROM m UNION ALL SELECT 'recall', rec FROM m
  UNION ALL SELECT 'cost_per_fraud_detected', cpf FROM m UNION ALL SELECT 'customer_impact_ratio', cir FROM m
  UNION ALL SELECT 'false_positive_rate', fpr FROM m),
 al(metric, f) AS (VALUES ('pr_auc', 0.9), ('precision', 0.8), ('recall', 0.85), ('false_positive_rate', 1.5))""",
    """SELECT "group", code, metric, round(value, 6) AS value, round(lim::DOUBLE, 6) AS "limit" FROM r JOIN v USING (metric)
  WHERE (op = '<' AND value < lim) OR (op = '>' AND value > lim)
 UNION ALL SELECT 'grade', CASE WHEN prauc >= 0.8 THEN 'Excellent' WHEN prauc >= 0.6 THEN 'Good' WHEN prauc >= 0.4 THEN 'Fair' ELSE 'Poor' END,
  'pr_auc', round(prauc, 6), NULL FROM m
 UNION ALL SELECT 'threshold_advice', CASE WHEN pre < 0.3 THEN 'increase_threshold' WHEN rec < 0.7 THEN 'decrease_threshold' ELSE 'current_threshold' END,
  'precision', round(pre, 6), NULL FROM m
 UNION ALL SELECT 'alert', metric || '_alert', metric, round(value, 6), round(value * f::DOUBLE, 6) FROM al JOIN v USING (metric)""")
    o["e22_strategy_comparison"] = q(SCORED, CURVE, TUNED, UNIT, """SELECT strategy, round(net_benefit, 6) AS net_benefit,
 round(fraud_detection_rate - (tp + fn) / (tp + fp + fn + tn), 6) AS detection_improvement, round(customer_friction_rate, 6) AS customer_friction_rate,
 round(net_benefit * 12, 6) AS annual_benefit, round(net_benefit / greatest(false_positive_total, 1), 6) AS risk_adjusted_return,
 row_number() OVER (ORDER BY net_benefit DESC, strategy) AS benefit_rank, round(avg(customers_flagged) OVER (), 6) AS estimated_daily_reviews,
 greatest(1, floor(avg(customers_flagged) OVER () / 50))::BIGINT AS recommended_team_size FROM impact""")
    o["e22_confidence"] = q(SCORED, CURVE, TUNED, """SELECT s::BIGINT AS confidence_score, CASE WHEN s >= 80 THEN 'high' WHEN s >= 60 THEN 'medium' ELSE 'low' END AS confidence
 FROM (SELECT least(count(*) FILTER (strategy LIKE '%\\_optimal' ESCAPE '\\') * 20, 60) + 40 AS s FROM tuned) x""")
    # ----------------------------------------------------------- comparison
    o["e23_rank_models"] = q(SCORED, MODELS, MODEL_METRICS, """l AS (SELECT model, 'pr_auc' AS metric, pr_auc AS value FROM mm UNION ALL SELECT model, 'roc_auc', roc_auc FROM mm
 UNION ALL SELECT model, 'f1_score', f1_score FROM mm UNION ALL SELECT model, 'precision', "precision" FROM mm UNION ALL SELECT model, 'recall', recall FROM mm
 UNION ALL SELECT model, 'overall', pr_auc * 0.3 + f1_score * 0.3 + "precision" * 0.2 + recall * 0.2 FROM mm)""",
    "SELECT model, metric, round(value, 6) AS value, rank() OVER (PARTITION BY metric ORDER BY value DESC) AS metric_rank FROM l")
    o["e24_compare_results"] = q(*swept([0.5, 0.6]), CURVE, COMPARE, f"SELECT metric_name, {r6('imbalanced_value', 'balanced_value', 'difference', 'percent_change')} FROM cmp")
    o["e25_trade_offs"] = q(*swept([0.5, 0.6]), CURVE, COMPARE, "c AS (SELECT " + ", ".join(
        f"max(CASE WHEN metric_name = '{m}' THEN difference END) AS {n}" for m, n in
        (("precision", "p"), ("recall", "r"), ("false_positive_rate", "f"), ("f1_score", "f1"))) +
        ", max(CASE WHEN metric_name = 'Train Samples' THEN 1 - balanced_value / imbalanced_value END) AS red FROM cmp)",
    """SELECT (p > 0)::INTEGER AS precision_improvement, round(p, 6) AS precision_change, (r > 0)::INTEGER AS recall_improvement,
 round(r, 6) AS recall_change, (f < 0)::INTEGER AS lower_customer_friction, round(f, 6) AS fpr_change, (f1 > 0)::INTEGER AS f1_improvement,
 round(f1, 6) AS f1_change, round(red, 6) AS training_data_reduction FROM c""")
    o["e27_metric_differences"] = q(*swept([0.5, 0.6]), CURVE, COMPARE, "SELECT metric_name, round(difference, 6) AS difference FROM cmp")
    # -------------------------------------------------------------- streams
    o["t2_stream_windows"] = q(TX, f"b AS ({SENDER})", f"d AS ({NOVELTY})", "SELECT * FROM b JOIN d USING (transaction_id)")
    o["t3_stream_velocity"] = q(TX, f"b AS ({SENDER})", """SELECT transaction_id, tx_count_last_1h, tx_count_last_24h,
 total_amount_last_24h, velocity_1h FROM b""")
    # A window is final once the watermark, one hour behind the last row, has passed its end.
    o["t4_hourly_counts"] = q(TX, """SELECT sender_account, epoch(w)::BIGINT AS window_start, count(*) AS tx_count,
 round(sum(amount), 4) AS total_amount FROM (SELECT *, date_trunc('hour', "timestamp") AS w FROM tx) x
 WHERE w + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max("timestamp")) - INTERVAL 1 HOUR FROM tx) GROUP BY 1, 2""")
    o["t4_daily_sliding_counts"] = q(TX, """SELECT sender_account, epoch(w)::BIGINT AS window_start, count(*) AS tx_count,
 round(sum(amount), 4) AS total_amount
 FROM (SELECT *, date_trunc('hour', "timestamp") - to_hours(h::INTEGER) AS w FROM tx, range(24) r(h)) x
 WHERE w + INTERVAL 24 HOUR <= (SELECT date_trunc('milliseconds', max("timestamp")) - INTERVAL 1 HOUR FROM tx) GROUP BY 1, 2""")
    o["t5_stream_dedup"] = q(TX, "SELECT transaction_id, sender_account, amount FROM tx")
    o["t6_stream_errors"] = q(TX, """e AS (SELECT CASE WHEN n % 101 = 0 THEN 'MissingValueError' WHEN n % 13 = 0 THEN 'AmountError' END AS error_type FROM tx)""",
    "SELECT error_type IS NOT NULL AS has_error, error_type, count(*) AS n_rows FROM e GROUP BY 1, 2")
    o["e26_recommendations"] = q(*swept([0.5, 0.6]), CURVE, COMPARE, """c AS (SELECT """ + ", ".join(
        f"max(CASE WHEN metric_name = '{m}' THEN difference END) AS {n}" for m, n in
        (("precision", "p"), ("recall", "r"), ("false_positive_rate", "f"), ("f1_score", "f1"))) +
        """, max(CASE WHEN metric_name = 'Train Samples' THEN 1 - balanced_value / imbalanced_value END) AS red FROM cmp),
 l AS (SELECT 0 AS i, CASE WHEN f1 > 0 THEN 'prefer_balanced' ELSE 'prefer_imbalanced' END AS code FROM c
  UNION ALL SELECT 1, CASE WHEN p > 0 AND r > 0 THEN 'precision_and_recall_gain' WHEN r > 0 THEN 'more_fraud_caught_more_alarms'
   WHEN p > 0 THEN 'fewer_alarms_more_fraud_missed' END FROM c
  UNION ALL SELECT 2, CASE WHEN f < 0 THEN 'friction_reduced' ELSE 'friction_not_reduced' END FROM c
  UNION ALL SELECT 3, CASE WHEN red > 0.5 THEN 'training_cost_reduced' END FROM c)""",
    "SELECT (row_number() OVER (ORDER BY i) - 1)::INTEGER AS position, code FROM l WHERE code IS NOT NULL")
    # -------------------------------------------------------------- sources
    o["s4_json_requests"] = q(TX, """SELECT transaction_id, sender_account, amount FROM tx""")
    o["s7_request_defaults"] = q(TX, """SELECT transaction_id, CASE WHEN n % 3 = 0 THEN 'sender_unknown' ELSE sender_account END AS sender_account,
 CASE WHEN n % 5 = 0 THEN 'unknown' ELSE location END AS location, CASE WHEN n % 7 = 0 THEN 0.0 ELSE k::DOUBLE END AS amount,
 'payment' AS transaction_type, merchant_category FROM tx""")
    o["s1_csv_with_label"] = q(TX, """SELECT transaction_id, epoch_us("timestamp") AS micros, receiver_account,
 round(amount, 4) AS amount, is_fraud FROM tx""")
    o["s2_first_rows"] = q(TX, "SELECT transaction_id, round(amount, 4) AS amount FROM tx ORDER BY transaction_id LIMIT 100")
    o["s3_csv_without_label"] = q(TX, """SELECT transaction_type, count(*) AS n_rows, round(sum(amount), 4) AS amount FROM tx
 GROUP BY transaction_type""")
    o["s5_one_request"] = q(TX, """SELECT transaction_id, sender_account, amount, location FROM tx
 ORDER BY "timestamp" DESC, transaction_id DESC LIMIT 1""")
    o["s6_load_evaluation"] = q(TX, """SELECT is_fraud, count(*) AS n_rows, count(DISTINCT sender_account) AS n_senders FROM tx
 GROUP BY is_fraud""")
    o["s8_csv_sink"] = q(SCORED, "SELECT transaction_id, y, p FROM scored")
    o["s9_json_sink"] = q(SCORED, """SELECT count(*) AS n_rows, count(*) FILTER (transaction_id::BIGINT % 17 <> 0) AS n_numbers,
 sum(y)::BIGINT AS n_positive, count(*) AS n_told FROM scored""")
    o["s10_report"] = q(SCORED, grid(SWEEP), SWEPT, "SELECT threshold, tp, fp, fn, tn FROM counts")
    o["s11_evaluation_sink"] = q(SCORED, """SELECT sum((y = 1 AND p >= 0.5)::INT) AS tp, sum((y = 0 AND p >= 0.5)::INT) AS fp,
 sum((y = 1 AND p < 0.5)::INT) AS fn, sum((y = 0 AND p < 0.5)::INT) AS tn, 0.5::DOUBLE AS threshold FROM scored""")
    o["s12_project"] = q(SCORED, "SELECT p, transaction_id FROM scored")
    o["v2_bound_rows"] = q(TX, DIRTY, "SELECT count(*) AS n_rows, count(amount) AS n_amounts FROM dirty")
    o["v14_compare_schema"] = """SELECT * FROM (VALUES ('location', 'missing'), ('extra', 'extra'), ('amount', 'type')) v("column", problem),
 (SELECT count(*) AS n_rows FROM events) e"""
    o["v16_align_columns"] = q(TX, "SELECT transaction_id, round(amount, 4) AS amount, 0.5::DOUBLE AS absent FROM tx")
    o["v17_completeness"] = "SELECT count(*) AS n_rows, 2 AS n_found, 'absent' AS missing, 8 AS n_extra FROM events"
    o["p5_one_hot_vector"] = q(TX, """SELECT transaction_id, dense_rank() OVER (ORDER BY transaction_type) - 1 AS place,
 (SELECT count(DISTINCT transaction_type) FROM tx) AS width FROM tx""")
    o["p10_preprocessor"] = q(TX, """SELECT transaction_id, round(ln(1 + amount), 6) AS amount,
 dense_rank() OVER (ORDER BY location) - 1 AS location, dense_rank() OVER (ORDER BY device_used) - 1 AS device_used,
 dense_rank() OVER (ORDER BY merchant_category) - 1 AS merchant_category FROM tx""")
    o["d9_canonical_order"] = q(TX, "SELECT transaction_id, round(amount, 4) AS amount, 8 AS n_empty FROM tx")
    o["e30_latency_report"] = q(TX, """SELECT count(DISTINCT date_trunc('day', "timestamp")) AS n_batches, count(*) AS n_rows,
 true AS ordered FROM tx""")
    texts = {"timestamp": """epoch_us("timestamp")""", "amount": "round(amount * 100)::BIGINT"}
    columns = sorted(["transaction_id", "timestamp", "sender_account", "receiver_account", "amount", "transaction_type",
                      "merchant_category", "location", "device_used", "is_fraud"])
    row = " || '|' || ".join(f"coalesce('=' || {texts.get(c, c)}, '-')" for c in columns)
    o["v24_fingerprint"] = q(TX, f"h AS (SELECT ('0x' || substr(md5({row}), 1, 15))::BIGINT AS h FROM tx)",
    "SELECT count(*) AS n_rows, bit_xor(h) AS xor_hash, sum(h % 1000000007)::BIGINT AS sum_hash FROM h")
    return o
