"""Attribution and explanations on orders; a fixed linear rule stands in for a model where SQL checks the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import attribution, drift, explanation, models
from tidegauge.operators.sampling import stratified_split
from tidegauge.operators.versioning import RunVersion
from tidegauge.plans import explain_run
from tidegauge.plans.explain_run import explain_rows
from tidegauge.session import scratch_path
from workload import common as c
from workload.drift_queries import SPLIT_SQL

QUERIES, ORACLE = {}, {}


def query(sql=None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


def attributed(spark, sf_dir, *keep):
    rows = c.order_features(spark, sf_dir)
    means = attribution.background_means(rows, c.ORDER_FEATURES)
    return attribution.linear_attribution(rows, c.ORDER_WEIGHTS, means, ["o_orderkey", *keep])


def explanations(spark, sf_dir):
    return explanation.local_explanations(
        attributed(spark, sf_dir, "prediction", "confidence"),
        F.col("prediction"),
        F.col("confidence"),
        explanation.alert_id("orders", F.col("o_orderkey")),
        top_k=3,
        keep=["o_orderkey"],
    )


IMPACTS_SQL = f"""
rows AS ({c.ORDER_FEATURES_SQL}),
impacts AS ({" UNION ALL ".join(
    f"SELECT o_orderkey, prediction, confidence, {i} AS position, '{f}' AS feature, "
    f"{w!r}::DOUBLE * ({f} - (SELECT avg({f}) FROM rows)) AS impact FROM rows"
    for i, (f, w) in enumerate(c.ORDER_WEIGHTS.items())
)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(impact) DESC, position) AS rank FROM impacts),
top AS (SELECT * FROM ranked WHERE rank <= 3)"""


@query(f"WITH {IMPACTS_SQL} SELECT o_orderkey, feature, round(impact, 6) + 0.0 AS impact FROM impacts")
def linear_shap(spark, sf_dir):
    rows = attributed(spark, sf_dir).select("o_orderkey", F.inline("impacts"))
    return rows.withColumn("impact", F.round("impact", 6) + 0.0)


@query(
    f"""WITH {IMPACTS_SQL} SELECT o_orderkey, 'ORDERS-' || o_orderkey AS alert_id, prediction::VARCHAR AS prediction,
    round(confidence, 4) AS confidence, (rank - 1)::INTEGER AS place, feature, round(impact, 6) + 0.0 AS impact,
    CASE WHEN impact > 0 THEN 'increase_risk' ELSE 'decrease_risk' END AS direction FROM top"""
)
def local_explanations(spark, sf_dir):
    rows = explanations(spark, sf_dir).select(
        "o_orderkey", "alert_id", "prediction", "confidence", F.posexplode("top_contributors").alias("place", "item")
    )
    rows = rows.select("o_orderkey", "alert_id", "prediction", "confidence", "place", "item.*")
    return rows.withColumn("impact", F.col("impact") + 0.0)


@query(
    f"""WITH {IMPACTS_SQL},
    raised AS (SELECT o_orderkey, string_agg(feature, ', ' ORDER BY rank) AS names FROM
      (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY rank) AS k FROM top WHERE impact > 0) WHERE k <= 2 GROUP BY 1),
    lowered AS (SELECT o_orderkey, string_agg(feature, ', ' ORDER BY rank) AS names FROM
      (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY rank) AS k FROM top WHERE impact < 0) WHERE k <= 2 GROUP BY 1)
    SELECT rows.o_orderkey, concat_ws('. ', 'High influence from ' || raised.names || ' increased attack likelihood',
      'Features like ' || lowered.names || ' reduced risk score') || '.' AS summary
    FROM rows LEFT JOIN raised USING (o_orderkey) LEFT JOIN lowered USING (o_orderkey)"""
)
def local_summary(spark, sf_dir):
    return explanations(spark, sf_dir).select("o_orderkey", "summary")


@query("SELECT o_orderkey, 'ORDERS-' || o_orderkey AS alert_id FROM orders")
def alert_ids(spark, sf_dir):
    orders = c.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", explanation.alert_id("orders", F.col("o_orderkey")).alias("alert_id"))


GLOBAL_SQL = f"""{IMPACTS_SQL},
importance AS (SELECT position, feature, avg(abs(impact)) AS mean_abs_impact FROM impacts GROUP BY 1, 2)"""


@query(
    f"WITH {GLOBAL_SQL} SELECT feature, round(mean_abs_impact, 6) AS mean_abs_impact FROM importance "
    "ORDER BY importance.mean_abs_impact DESC, position LIMIT 3"
)
def global_importance(spark, sf_dir):
    top = explanation.global_importance(attributed(spark, sf_dir), c.ORDER_FEATURES, 3)
    return top.withColumn("mean_abs_impact", F.round("mean_abs_impact", 6))


@query(
    f"""WITH {GLOBAL_SQL}, ordered AS (SELECT *, row_number() OVER (ORDER BY mean_abs_impact DESC, position) AS rank FROM importance)
    SELECT 'orders' AS dataset, 'linear_rule' AS model, string_agg(feature, ',' ORDER BY rank) AS features,
    'Model decisions are primarily influenced by traffic volume, connection behavior, and destination activity features such as '
      || string_agg(feature, ', ' ORDER BY rank) FILTER (WHERE rank <= 5) AS interpretation FROM ordered"""
)
def policy_report(spark, sf_dir):
    report = explanation.policy_report(attributed(spark, sf_dir), c.ORDER_FEATURES, "orders", "linear_rule")
    return report.select(
        "dataset", "model", F.array_join("top_global_features.feature", ",").alias("features"), "interpretation"
    )


def order_sides(spark, sf_dir):
    rows = c.order_features(spark, sf_dir)
    split = F.lit("1998-01-01").cast("timestamp_ntz")
    return rows.where(F.col("o_orderdate") < split), rows.where(F.col("o_orderdate") >= split)


def order_drift(spark, sf_dir):
    """Late orders with prices scaled up, against early orders."""
    early, late = order_sides(spark, sf_dir)
    return drift.feature_drift(early, drift.perturb(late, ["o_totalprice"]), c.ORDER_FEATURES)


ORDER_DRIFT_SQL = c.drift_ctes(
    "SELECT * FROM rows WHERE o_orderdate < TIMESTAMP '1998-01-01'",
    "SELECT * FROM rows WHERE o_orderdate >= TIMESTAMP '1998-01-01'",
    {f: (f, f"{f} * 1.4::DOUBLE" if f == "o_totalprice" else f) for f in c.ORDER_FEATURES},
)


@query(
    f"""WITH {IMPACTS_SQL}, {ORDER_DRIFT_SQL},
    joined AS (SELECT top.o_orderkey, top.rank, top.feature, report.status FROM top LEFT JOIN report ON top.feature = report.feature)
    SELECT o_orderkey,
      coalesce(string_agg(feature || ':' || status, ',' ORDER BY rank) FILTER (WHERE status <> 'no_drift'), '') AS drifting,
      coalesce(string_agg(feature, ',' ORDER BY rank) FILTER (WHERE coalesce(status, 'no_drift') = 'no_drift'), '') AS stable,
      CASE WHEN count(*) FILTER (WHERE status <> 'no_drift') > 0 THEN 'Some influential features are drifting'
           ELSE 'Top features are stable' END AS note
    FROM joined GROUP BY o_orderkey"""
)
def drift_context(spark, sf_dir):
    rows = explanation.with_drift_context(explanations(spark, sf_dir), order_drift(spark, sf_dir))
    pairs = F.transform("drift_context.drifting_features", lambda d: F.concat_ws(":", d["feature"], d["drift_status"]))
    return rows.select(
        "o_orderkey",
        F.array_join(pairs, ",").alias("drifting"),
        F.array_join("drift_context.stable_features", ",").alias("stable"),
        F.col("drift_context.note").alias("note"),
    )


@query("SELECT o_orderkey, 0::INTEGER AS drifting, 'No drift context available' AS note FROM orders")
def drift_context_without_report(spark, sf_dir):
    rows = explanation.with_drift_context(explanations(spark, sf_dir), None)
    return rows.select(
        "o_orderkey",
        F.size("drift_context.drifting_features").alias("drifting"),
        F.col("drift_context.note").alias("note"),
    )


# --- fitted models: rows only ----------------------------------------------------------------------------------------


def order_table(spark, sf_dir):
    """Orders with the label finished or not, which no feature holds."""
    return c.order_features(spark, sf_dir).drop("prediction", "confidence")


def spread(rows):
    """Rows over at least as many partitions as there are cores: attribution is long work on few bytes."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, len(rows.inputFiles())), "o_orderkey")


def fitted(rows):
    """The preset forest on a bounded part of the rows, which is drawn once and not in each pass of the training."""
    part = models.assemble(c.fit_rows(rows), c.ORDER_FEATURES, ["label"]).persist()
    try:
        return models.train(models.random_forest(), part)
    finally:
        part.unpersist()


def order_forest(spark, sf_dir):
    """All orders and the preset forest, fitted on a bounded part of them."""
    rows = order_table(spark, sf_dir)
    return spread(rows), fitted(rows)


def _tree_impacts(spark, sf_dir):
    rows, model = order_forest(spark, sf_dir)
    kept = ["o_orderkey", *c.ORDER_FEATURES]
    scored = models.score(model, models.assemble(rows, c.ORDER_FEATURES, kept), kept, by_cell=True)
    return attribution.tree_attribution(scored, model, c.ORDER_FEATURES, ["o_orderkey", "probability"])


@query()
def tree_shap(spark, sf_dir):
    """Impacts of every order."""
    impacts, _ = _tree_impacts(spark, sf_dir)
    named = [attribution.impact_column(F.col("impacts"), f).alias(f) for f in c.ORDER_FEATURES]
    return impacts.select("o_orderkey", *named)


@query("SELECT o_orderkey, 0.0::DOUBLE AS rest FROM orders")
def tree_shap_additivity(spark, sf_dir):
    """What impacts and base value leave of the model's probability: nothing, for every order."""
    impacts, base = _tree_impacts(spark, sf_dir)
    total = F.aggregate("impacts", F.lit(base), lambda t, item: t + item["impact"])
    return impacts.select("o_orderkey", (F.round(total - F.col("probability")[1], 6) + 0.0).alias("rest"))


@query("SELECT o_orderstatus AS label, count(*) AS rows, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::INTEGER AS index FROM orders GROUP BY o_orderstatus")
def label_dictionary(spark, sf_dir):
    """Saved and loaded classes of a text label, and the rows that map to each of them."""
    orders, path = c.table(spark, sf_dir, "orders"), scratch_path(spark, "labels")
    models.LabelDictionary.fit(orders, "o_orderstatus").save(spark, path)
    known = models.LabelDictionary.load(spark, path)
    index = known.encode(F.col("o_orderstatus"))
    return orders.groupBy(known.decode(index).alias("label"), index.cast("int").alias("index")).agg(F.count("*").alias("rows"))


def status_forest(spark, sf_dir):
    """Orders with their features, the preset forest for the three states of an order, and the states' names."""
    rows = order_table(spark, sf_dir)
    labels = models.LabelDictionary.fit(rows, "o_orderstatus")
    rows = rows.withColumn("label", labels.encode(F.col("o_orderstatus")))
    return spread(rows), labels, fitted(rows)


@query("SELECT o_orderkey, true AS named, 0.0::DOUBLE AS rest FROM orders")
def class_shap_additivity(spark, sf_dir):
    """Three classes: impacts on the predicted class and its base value leave nothing of its probability."""
    rows, labels, model = status_forest(spark, sf_dir)
    kept = ["o_orderkey", *c.ORDER_FEATURES]
    scored = models.score(model, models.assemble(rows, c.ORDER_FEATURES, kept), kept, by_cell=True)
    impacts, base = attribution.tree_attribution(scored, model, c.ORDER_FEATURES, ["o_orderkey", "prediction", "probability"], target="prediction")
    index = F.col("prediction").cast("int")
    total = F.aggregate("impacts", F.get(F.array(*map(F.lit, base)), index), lambda t, item: t + item["impact"])
    named = labels.decode(F.col("prediction")).isin(*labels.names)
    return impacts.select("o_orderkey", named.alias("named"), (F.round(total - F.get("probability", index), 6) + 0.0).alias("rest"))


@query(
    f"""WITH {SPLIT_SQL} SELECT o_orderkey, true AS named, 4 AS contributors FROM parts WHERE part = 'test' ORDER BY o_orderkey LIMIT 1 OFFSET 20"""
)
def explain_test_row(spark, sf_dir):
    """The 21st row of the test part: predicted state by name, impacts on that state."""
    rows, labels, model = status_forest(spark, sf_dir)
    parts = stratified_split(rows, "o_orderstatus", "o_orderkey")
    version = RunVersion(c.MODEL, "orders_v1", c.RUN, c.NOON)
    shown = explain_run.explain_test_row(parts, 20, model, c.ORDER_FEATURES, "o_orderkey", "orders", version, labels=labels, explained_class="predicted")
    return shown.select("o_orderkey", F.col("prediction").isin(*labels.names).alias("named"), F.size("top_contributors").alias("contributors"))


@query()
def explain_batch(spark, sf_dir):
    rows, model = order_forest(spark, sf_dir)
    version = RunVersion(c.MODEL, "orders_v1", c.RUN, c.NOON)
    explained = explain_rows(rows, model, c.ORDER_FEATURES, "o_orderkey", "orders", version, order_drift(spark, sf_dir))
    return explained.select(
        "o_orderkey", "alert_id", "prediction", "confidence", "summary", F.col("drift_context.note").alias("note"), F.col("metadata.run_id").alias("run_id")
    )


@query()
def explain_linear_model(spark, sf_dir):
    rows = order_table(spark, sf_dir)
    model = models.train(models.logistic_regression(rows.count()), models.assemble(rows, c.ORDER_FEATURES, ["label"]))
    version = RunVersion(c.MODEL, "orders_v1", c.RUN, c.NOON)
    explained = explain_rows(rows, model, c.ORDER_FEATURES, "o_orderkey", "orders", version)
    return explained.select("o_orderkey", "alert_id", "prediction", "confidence", "summary")
