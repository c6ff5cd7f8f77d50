"""Drift, policy, health and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.config import PROCESSED_LIMITS
from tidegauge.operators import drift, policy, ranks
from tidegauge.operators.preprocessing import FlowPreprocessor
from tidegauge.operators.sampling import stratified_split
from tidegauge.operators.versioning import RunVersion
from tidegauge.plans.drift_run import run_drift
from workload import common as c

QUERIES, ORACLE = {}, {}


def query(sql=None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def listed(report):
    return report.select("feature", "psi", "status", "baseline_rows", "current_rows", F.round("psi_raw", 6).alias("psi_raw"))


REPORT_SQL = "SELECT feature, psi, status, baseline_rows, current_rows, round(psi_raw, 6) AS psi_raw FROM report"


def shifted_report(spark, sf_dir):
    return drift.drift_report(c.shifted_lineitem(spark, sf_dir), c.lineitem_profile(spark, sf_dir))


@query(f"WITH {c.RAW_DRIFT_SQL} {REPORT_SQL}")
def drift_report_raw(spark, sf_dir):
    baseline, current = c.lineitem_sides(spark, sf_dir)
    return listed(drift.feature_drift(baseline, current, [*c.DRIFT_FEATURES, "l_returnflag"]))


@query(f"WITH {c.SHIFTED_DRIFT_SQL} {REPORT_SQL}")
def drift_report_simulated(spark, sf_dir):
    baseline, current = c.lineitem_sides(spark, sf_dir)
    return listed(drift.feature_drift(baseline, current, c.DRIFT_FEATURES, simulate=True))


SCALES = [float(f) for f in drift.np.random.default_rng(42).uniform(2.5, 4.0, 5)]
SCALED = {f: (f, f"{f} * {s!r}::DOUBLE") for f, s in zip(c.DRIFT_FEATURES, SCALES)}


@query(f"WITH {c.drift_ctes(c.BASE_SQL, c.CURRENT_SQL, SCALED)} {REPORT_SQL}")
def drift_report_scaled(spark, sf_dir):
    current = c.lineitem_sides(spark, sf_dir)[1].select(*c.DRIFT_FEATURES)
    return listed(drift.drift_report(drift.perturb_numeric(current), c.lineitem_profile(spark, sf_dir)))


@query(
    f"WITH {c.RAW_DRIFT_SQL}, numbered AS (SELECT feature, unnest(inner_edges) AS edge FROM edges) "
    "SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY edge) AS edge_no, round(edge, 6) AS edge FROM numbered"
)
def drift_edges(spark, sf_dir):
    profile = c.lineitem_profile(spark, sf_dir).to_df(spark)
    numbered = profile.select("feature", F.posexplode("edges").alias("place", "edge"))
    return numbered.select(
        "feature", (F.col("place") + 1).cast("bigint").alias("edge_no"), F.round("edge", 6).alias("edge")
    )


QUANTILE_COLUMNS = {
    "price": "l_extendedprice",
    "quantity": "l_quantity",
    "sparse": "CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice END",
}
SHARES = (0.0, 0.1, 0.5, 0.9, 1.0)


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {s}::DOUBLE AS share, round(quantile_cont(({sql})::DOUBLE, {s}), 6) AS value FROM lineitem"
        for n, sql in QUANTILE_COLUMNS.items()
        for s in SHARES
    )
)
def quantiles_in_rounds(spark, sf_dir):
    """Exact quantiles, one of a sparse column, when little may be read at once."""
    columns = {n: F.expr(sql).cast("double") for n, sql in QUANTILE_COLUMNS.items()}
    budget = ranks.Budget(sample_rows=500, sample_values=2_000, read=300)
    found = ranks.exact_quantiles(c.table(spark, sf_dir, "lineitem"), columns, SHARES, budget=budget)
    rows = [(n, share, q.value) for n, (_, quantiles) in found.items() for share, q in zip(SHARES, quantiles)]
    return spark.createDataFrame(rows, "feature string, share double, value double").withColumn("value", F.round("value", 6))


@query(f"WITH {c.SHIFTED_DRIFT_SQL} SELECT feature, bin, expected_rows, actual_rows FROM counts")
def drift_bin_freq(spark, sf_dir):
    profile = c.lineitem_profile(spark, sf_dir)
    rows = drift.bin_frequencies(drift.bin_counts(c.shifted_lineitem(spark, sf_dir), profile), profile)
    return rows.withColumn("bin", F.col("bin").cast("bigint"))


@query(f"WITH {c.SHIFTED_DRIFT_SQL} SELECT feature, psi, status FROM report ORDER BY psi DESC, feature LIMIT 3")
def drift_top(spark, sf_dir):
    return shifted_report(spark, sf_dir).select("feature", "psi", "status").limit(3)


@query(
    f"WITH {c.SHIFTED_DRIFT_SQL} SELECT 'lineitem' AS dataset, max(psi) AS psi, "
    "CASE WHEN max(psi) > 0.25 THEN 'high' WHEN max(psi) > 0.1 THEN 'medium' ELSE 'low' END AS drift_level, "
    "string_agg(feature, ',' ORDER BY position) FILTER (WHERE status = 'severe_drift') AS features FROM report"
)
def drift_snapshot(spark, sf_dir):
    snapshot = drift.drift_snapshot(shifted_report(spark, sf_dir), "lineitem", c.at_noon())
    return snapshot.select("dataset", "psi", "drift_level", F.array_join("features", ",").alias("features"))


@query(
    f"WITH {c.SHIFTED_DRIFT_SQL}, {c.FACTS_SQL} SELECT drift_level, severe_count, moderate_count, total_features, "
    "severe_ratio, moderate_ratio FROM verdict"
)
def drift_summary(spark, sf_dir):
    return policy.drift_summary(shifted_report(spark, sf_dir))


@query(f"WITH {c.SHIFTED_DRIFT_SQL} SELECT feature, psi FROM report WHERE status = 'severe_drift'")
def drift_severe_features(spark, sf_dir):
    return drift.status_rows(shifted_report(spark, sf_dir), "severe_drift").select("feature", "psi")


def _scaled(name):
    stats = f"(SELECT avg({name}::DOUBLE) AS m, stddev_pop({name}::DOUBLE) AS s FROM ({c.BASE_SQL}))"
    return f"({{value}} - (SELECT m FROM {stats})) / (SELECT s FROM {stats})"


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DOUBLED = {f: (_scaled(f).format(value=f), _scaled(f).format(value=f"{f} * {2 if i < 2 else 1}")) for i, f in enumerate(NUMBERS)}
PROCESSED_SQL = c.drift_ctes(c.BASE_SQL, c.CURRENT_SQL, DOUBLED, ("l_linestatus_F", "l_linestatus_O"), 0.2)


@query(f"WITH {PROCESSED_SQL} SELECT feature, psi, status FROM report")
def drift_processed(spark, sf_dir):
    baseline, current = c.lineitem_sides(spark, sf_dir)
    model = FlowPreprocessor(["l_linestatus"], NUMBERS).fit(baseline)
    profile = drift.fit_profile(model.transform(baseline))
    processed = model.transform(drift.perturb(current, NUMBERS, 2.0, 2))
    return drift.drift_report(processed, profile, PROCESSED_LIMITS).select("feature", "psi", "status")


SPLIT_SQL = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {c.hash_sql('o_orderkey')}, o_orderkey) AS rn FROM orders),
sizes AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus),
target AS (SELECT ceil(sum(n) * 0.2)::BIGINT AS t, sum(n)::BIGINT AS total FROM sizes),
whole AS (SELECT o_orderstatus, (n * t) // total AS w, (n * t) % total AS rest, t FROM sizes, target),
quota AS (
  SELECT o_orderstatus, w + CASE WHEN row_number() OVER (ORDER BY rest DESC, o_orderstatus) <= t - sum(w) OVER () THEN 1 ELSE 0 END AS q
  FROM whole
),
parts AS (SELECT ranked.*, CASE WHEN rn <= q THEN 'test' ELSE 'train' END AS part FROM ranked JOIN quota USING (o_orderstatus))"""

STABLE_SQL = c.drift_ctes(
    "SELECT * FROM parts WHERE part = 'train'",
    "SELECT * FROM parts WHERE part = 'test'",
    {"o_totalprice": ("o_totalprice", "o_totalprice"), "o_custkey": ("o_custkey", "o_custkey")},
)


@query(f"WITH {SPLIT_SQL}, {STABLE_SQL} {REPORT_SQL}")
def drift_stability(spark, sf_dir):
    """Two random parts of one table should not drift."""
    parts = stratified_split(c.table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey")
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    return listed(drift.feature_drift(train, test, ["o_totalprice", "o_custkey"]))


@query(
    f"""WITH {c.SHIFTED_DRIFT_SQL} SELECT CASE WHEN psi <= 0.25 THEN 'warning' ELSE 'critical' END AS type, feature, psi,
    'lineitem' AS dataset, '{c.MODEL}' AS model_version, '{c.NOON}' AS created,
    CASE WHEN psi <= 0.25 THEN 'Moderate drift detected. Monitor closely.'
         ELSE 'Severe drift detected. Retraining recommended.' END AS message FROM report WHERE psi > 0.1"""
)
def policy_alerts(spark, sf_dir):
    alerts = policy.policy_alerts(shifted_report(spark, sf_dir), "lineitem", c.MODEL, c.at_noon())
    return alerts.withColumn("created", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).drop("timestamp")


@query(
    f"WITH {c.SHIFTED_DRIFT_SQL}, {c.FACTS_SQL} SELECT alert_count, retrain_required, max_psi, '{c.MODEL}' AS model_version FROM facts"
)
def policy_decision(spark, sf_dir):
    return policy.policy_decision(shifted_report(spark, sf_dir), c.MODEL)


@query(
    f"WITH {c.SHIFTED_DRIFT_SQL}, {c.FACTS_SQL} SELECT '{c.MODEL}' AS model, status, action, reason, max_psi, drift_level, "
    "severe_ratio FROM health"
)
def model_health(spark, sf_dir):
    return policy.model_health(shifted_report(spark, sf_dir), c.MODEL, c.at_noon()).drop("timestamp")


LEVEL_SQL = "CASE drift_level WHEN 'low' THEN 0.2 WHEN 'medium' THEN 0.6 ELSE 1.0 END"


@query(
    f"""WITH {c.SHIFTED_DRIFT_SQL}, {c.FACTS_SQL},
    joined AS (SELECT *, (SELECT avg(confidence) FROM ({c.SCORED_SQL})) AS confidence FROM verdict),
    indexed AS (SELECT *, round((0.65 * {LEVEL_SQL} + 0.35 * (1 - confidence))::DOUBLE, 3) AS alert_index FROM joined)
    SELECT drift_level, round(confidence, 6) AS confidence, alert_index,
           least(alert_index + severe_ratio, 1.0::DOUBLE) AS combined FROM indexed"""
)
def alert_index(spark, sf_dir):
    confidence = c.scored_orders(spark, sf_dir).agg(F.avg("confidence")).scalar()
    summary = policy.drift_summary(shifted_report(spark, sf_dir)).withColumn("confidence", confidence)
    level, value = F.col("drift_level"), F.col("confidence")
    return summary.select(
        "drift_level",
        F.round(value, 6).alias("confidence"),
        policy.alert_index(level, value).alias("alert_index"),
        policy.combined_risk(level, value, F.col("severe_ratio")).alias("combined"),
    )


@query(
    f"""WITH leveled AS (SELECT confidence, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END AS drift_level
      FROM ({c.SCORED_SQL})),
    indexed AS (SELECT round((0.65 * {LEVEL_SQL} + 0.35 * (1 - confidence))::DOUBLE, 3) AS alert_index FROM leveled)
    SELECT CASE WHEN alert_index < 0.3 THEN 'green' WHEN alert_index < 0.6 THEN 'orange' ELSE 'red' END AS band,
           count(*) AS n FROM indexed GROUP BY 1"""
)
def risk_band(spark, sf_dir):
    status = F.col("o_orderstatus")
    level = F.when(status == "F", "high").when(status == "O", "medium").otherwise("low")
    index = policy.alert_index(level, F.col("confidence"))
    scored = c.scored_orders(spark, sf_dir).select(policy.risk_band(index).alias("band"))
    return scored.groupBy("band").agg(F.count("*").alias("n"))


@query(
    f"""WITH {c.SHIFTED_DRIFT_SQL}, {c.FACTS_SQL}
    SELECT CASE WHEN retrain_required THEN 'stale' ELSE 'healthy' END AS status,
           CASE WHEN retrain_required THEN 'drift_threshold_exceeded' ELSE 'no_significant_drift' END AS reason,
           CASE WHEN retrain_required THEN 'schedule_retraining' END AS action FROM facts"""
)
def staleness(spark, sf_dir):
    return policy.staleness(shifted_report(spark, sf_dir))


RUN_SQL = f"""
sampled AS (SELECT confidence FROM ({c.SCORED_SQL}) ORDER BY {c.hash_sql('o_orderkey')}, o_orderkey LIMIT 50),
run AS (SELECT *, round((0.65 * {LEVEL_SQL} + 0.35 * (1 - (SELECT avg(confidence) FROM sampled)))::DOUBLE, 3) AS idx FROM health),
final AS (SELECT *, least(idx + severe_ratio, 1.0::DOUBLE) AS alert_index FROM run)"""


@query(
    f"""WITH {c.SHIFTED_DRIFT_SQL}, {c.FACTS_SQL}, {RUN_SQL}
    SELECT 'lineitem' AS dataset, '{c.MODEL}' AS model, drift_level, severe_count, moderate_count, total_features, severe_ratio,
           moderate_ratio, max_psi, alert_count, retrain_required, status, action, reason, alert_index,
           CASE WHEN alert_index < 0.3 THEN 'green' WHEN alert_index < 0.6 THEN 'orange' ELSE 'red' END AS risk_band FROM final"""
)
def drift_run(spark, sf_dir):
    from tidegauge.plans.drift_run import mean_confidence

    run = run_drift(
        c.shifted_lineitem(spark, sf_dir),
        c.lineitem_profile(spark, sf_dir),
        "lineitem",
        RunVersion(c.MODEL, "lineitem_v1", c.RUN, c.NOON),
        mean_confidence(c.scored_orders(spark, sf_dir), "o_orderkey"),
        c.at_noon(),
        keep_report=False,
    )
    return run.outcome.drop("timestamp")


@query(
    f"""WITH {c.SHIFTED_DRIFT_SQL} SELECT sha256('{c.RUN}|lineitem|' || feature) AS alert_id, 'open' AS state, feature, psi,
    CASE WHEN psi <= 0.25 THEN 'warning' ELSE 'critical' END AS type FROM report WHERE psi > 0.1"""
)
def drift_run_alerts(spark, sf_dir):
    from tidegauge.operators.alerts import create_alerts

    payload = policy.policy_alerts(shifted_report(spark, sf_dir), "lineitem", c.MODEL, c.at_noon())
    return create_alerts(payload, c.RUN, c.at_noon()).select("alert_id", "state", "feature", "psi", "type")
