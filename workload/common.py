"""Shared inputs of the registered queries: stand-in contracts, splits, rules and SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.contract import Contract
from tidegauge.operators.drift import BaselineProfile, fit_profile, perturb
from tidegauge.operators.sampling import fixed_sample

SPLIT = "1997-01-01"
DRIFT_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
RUN = "run-1"
MODEL = "rf_v1"
NOON = "2024-01-01 12:00:00"

LINEITEM_FLOWS = Contract(
    label_column="l_returnflag",
    column_aliases={
        "l_quantity": "flow_duration",
        "l_extendedprice": "src_bytes",
        "l_tax": "dst_bytes",
        "l_linestatus": "protocol",
    },
    label_mapping={"N": 0, "A": 1, "R": 1},
    max_missing_pct=0.1,
    label_values=(0, 1),
    categorical_features=("protocol",),
    numeric_features=("flow_duration", "src_bytes", "dst_bytes"),
)

EVENTS_FLOWS = Contract(
    label_column="event_type",
    column_aliases={"value": "flow_duration", "props": "src_bytes"},
    label_mapping={"view": 0, "click": 1, "error": 1, "purchase": 1, "signup": 1},
    max_missing_pct=0.2,
    label_values=(0, 1),
    categorical_features=("protocol",),
    numeric_features=("flow_duration", "src_bytes", "dst_bytes"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at_noon() -> Column:
    return F.lit(NOON).cast("timestamp")


def lineitem_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lineitem = table(spark, sf_dir, "lineitem")
    split = F.lit(SPLIT).cast("timestamp_ntz")
    return lineitem.where(F.col("l_shipdate") < split), lineitem.where(F.col("l_shipdate") >= split)


_FROZEN: dict[tuple, BaselineProfile] = {}


def lineitem_profile(spark: SparkSession, sf_dir: str, features: list[str] | None = None) -> BaselineProfile:
    """Frozen baseline of lineitem; fitted once per data folder, as in production."""
    key = (sf_dir, *(features or DRIFT_FEATURES))
    if key not in _FROZEN:
        _FROZEN[key] = fit_profile(lineitem_sides(spark, sf_dir)[0], key[1:])
    return _FROZEN[key]


def forget_profiles() -> None:
    _FROZEN.clear()


def shifted_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturb(lineitem_sides(spark, sf_dir)[1], DRIFT_FEATURES, 1.4, 3)


# --- scoring rules on orders (stand in for a model) ------------------------------------------------------------------


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
        F.when(price > 250000, 1).otherwise(0).alias("prediction"),
        F.least(0.5 + F.abs(price - 250000) / 612345, F.lit(1.0)).alias("confidence"),
        F.when(price > 300000, "F").when(price > 150000, "O").otherwise("P").alias("guess"),
        F.when(price > 300000, 1).otherwise(0).alias("strict_rule"),
        F.when(price > 100000, 1).otherwise(0).alias("lenient_rule"),
    )


SCORED_SQL = """
SELECT o_orderkey, o_orderstatus,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
       CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS prediction,
       least(0.5::DOUBLE + abs(o_totalprice - 250000) / 612345, 1.0::DOUBLE) AS confidence,
       CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 150000 THEN 'O' ELSE 'P' END AS guess,
       CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS strict_rule,
       CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS lenient_rule
FROM orders"""

#: Labelled rows that the registered queries fit their models on, drawn by key; every row is scored and explained.
FIT_ROWS = 1_000


def fit_rows(rows: DataFrame, key: str = "o_orderkey") -> DataFrame:
    """At most ``FIT_ROWS`` rows, the same ones whatever the partitions, over a few partitions."""
    return fixed_sample(rows, FIT_ROWS, key).repartition(8, key)


ORDER_FEATURES = ["o_totalprice", "o_custkey", "order_month", "priority"]
ORDER_WEIGHTS = {"o_totalprice": 0.00001, "o_custkey": -0.0005, "order_month": 0.02, "priority": -0.1}


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric features of orders with the rule's prediction and confidence."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        "o_orderdate",
        price,
        F.col("o_custkey").cast("double").alias("o_custkey"),
        F.month("o_orderdate").cast("double").alias("order_month"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
        F.when(price > 250000, 1).otherwise(0).alias("prediction"),
        F.least(0.5 + F.abs(price - 250000) / 612345, F.lit(1.0)).alias("confidence"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("label"),
    )


ORDER_FEATURES_SQL = """
SELECT o_orderkey, o_orderstatus, o_orderdate, o_totalprice, o_custkey::DOUBLE AS o_custkey,
       month(o_orderdate)::DOUBLE AS order_month, substr(o_orderpriority, 1, 1)::DOUBLE AS priority,
       CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS prediction,
       least(0.5::DOUBLE + abs(o_totalprice - 250000) / 612345, 1.0::DOUBLE) AS confidence
FROM orders"""

HASH_SQL = "('0x' || substr(md5('42:' || {key}), 1, 13))::BIGINT::DOUBLE"


def hash_sql(key: str) -> str:
    return HASH_SQL.format(key=key)


# --- drift in SQL ----------------------------------------------------------------------------------------------------


def drift_ctes(base: str, current: str, features: dict[str, tuple[str, str]], texts: tuple[str, ...] = (), high: float = 0.25) -> str:
    """CTEs up to ``report`` for features given as (baseline expression, current expression)."""
    parts = []
    for position, (name, (b, c)) in enumerate(features.items()):
        parts.append(f"SELECT 0 AS side, {position} AS position, '{name}' AS feature, ({b})::DOUBLE AS v FROM ({base})")
        parts.append(f"SELECT 1 AS side, {position} AS position, '{name}' AS feature, ({c})::DOUBLE AS v FROM ({current})")
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate([*features, *texts]))
    shares = ", ".join(f"{k / 10}::DOUBLE" for k in range(11))
    place = "((len(s) - 1)::DOUBLE * p)"
    a, b = f"s[floor({place})::BIGINT + 1]", f"s[least(floor({place})::BIGINT + 2, len(s))]"
    part = f"({place} - floor({place}))"
    # interpolation in doubles as NumPy does it; quantile_cont may differ in the last bit, which can move a row
    interpolated = f"CASE WHEN {part} < 0.5 THEN {a} + ({b} - {a}) * {part} ELSE {b} - ({b} - {a}) * (1 - {part}) END"
    return f"""
x AS ({" UNION ALL ".join(parts)}),
names(position, feature) AS (VALUES {names}),
ordered AS (SELECT feature, list_sort(list(v)) AS s FROM x WHERE side = 0 GROUP BY feature),
cuts AS (SELECT feature, list_sort(list_distinct(list_transform([{shares}], lambda p: {interpolated}))) AS b FROM ordered),
edges AS (SELECT feature, b[2:len(b) - 1] AS inner_edges FROM cuts WHERE len(b) >= 3),
binned AS (
  SELECT x.feature, side, len(list_filter(inner_edges, lambda q: q < v)) AS bin FROM x JOIN edges USING (feature)
),
grid AS (SELECT feature, unnest(range(0, len(inner_edges) + 1)) AS bin FROM edges),
counts AS (
  SELECT grid.feature, grid.bin,
         count(*) FILTER (WHERE side = 0) AS expected_rows, count(*) FILTER (WHERE side = 1) AS actual_rows
  FROM grid LEFT JOIN binned ON grid.feature = binned.feature AND grid.bin = binned.bin GROUP BY ALL
),
shares AS (
  SELECT feature, bin, expected_rows / sum(expected_rows) OVER (PARTITION BY feature) AS e,
         actual_rows / sum(actual_rows) OVER (PARTITION BY feature) AS a FROM counts
),
psis AS (SELECT feature, sum((a - e) * ln((a + 1e-8) / (e + 1e-8))) AS psi_raw FROM shares GROUP BY feature),
report AS (
  SELECT position, feature, coalesce(psi_raw, 0.0) AS psi_raw, round(coalesce(psi_raw, 0.0), 4) AS psi,
         CASE WHEN coalesce(psi_raw, 0.0) > {high} THEN 'severe_drift'
              WHEN coalesce(psi_raw, 0.0) > 0.1 THEN 'moderate_drift' ELSE 'no_drift' END AS status,
         (SELECT count(*) FROM ({base})) AS baseline_rows, (SELECT count(*) FROM ({current})) AS current_rows
  FROM names LEFT JOIN psis USING (feature)
)"""


BASE_SQL = f"SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{SPLIT}'"
CURRENT_SQL = f"SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{SPLIT}'"
PLAIN = {f: (f, f) for f in DRIFT_FEATURES}
SHIFTED = {f: (f, f"{f} * 1.4::DOUBLE" if i < 3 else f) for i, f in enumerate(DRIFT_FEATURES)}

RAW_DRIFT_SQL = drift_ctes(BASE_SQL, CURRENT_SQL, PLAIN, ("l_returnflag",))
SHIFTED_DRIFT_SQL = drift_ctes(BASE_SQL, CURRENT_SQL, SHIFTED)

FACTS_SQL = """
facts AS (
  SELECT count(*) AS total_features, count(*) FILTER (WHERE status = 'severe_drift') AS severe_count,
         count(*) FILTER (WHERE status = 'moderate_drift') AS moderate_count,
         count(*) FILTER (WHERE psi > 0.1) AS alert_count, bool_or(psi > 0.25) AS retrain_required, max(psi) AS max_psi
  FROM report
),
verdict AS (
  SELECT *, CASE WHEN severe_count / total_features > 0.3 THEN 'high'
                 WHEN severe_count / total_features > 0.1 OR moderate_count / total_features > 0.3 THEN 'medium'
                 ELSE 'low' END AS drift_level,
         round(severe_count / total_features, 3) AS severe_ratio,
         round(moderate_count / total_features, 3) AS moderate_ratio
  FROM facts
),
health AS (
  SELECT *, CASE WHEN drift_level = 'high' OR severe_ratio > 0.3 THEN 'critical'
                 WHEN drift_level = 'medium' THEN 'degrading' ELSE 'healthy' END AS status,
         CASE WHEN drift_level = 'high' OR severe_ratio > 0.3 THEN 'retrain_required'
              WHEN drift_level = 'medium' THEN 'monitor_closely' ELSE 'none' END AS action,
         CASE WHEN drift_level = 'high' OR severe_ratio > 0.3 THEN 'widespread_severe_drift'
              WHEN drift_level = 'medium' THEN 'moderate_distribution_shift' ELSE 'within_safe_limits' END AS reason
  FROM verdict
)"""
