"""Samples, splits, classifier metrics, preprocessing and models."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.operators import boosting, evaluation, mapping, models, sampling
from tidegauge.operators.preprocessing import FlowPreprocessor
from tidegauge.session import scratch_path, written
from tidegauge.sources import sinks
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


# --- samples and splits ----------------------------------------------------------------------------------------------


@query(f"WITH {SPLIT_SQL} SELECT o_orderkey, o_orderstatus, part FROM parts")
def stratified_split(spark, sf_dir):
    parts = sampling.stratified_split(c.table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey")
    return parts.select("o_orderkey", "o_orderstatus", "part")


@query(ORACLE["stratified_split"])
def split_in_rounds(spark, sf_dir):
    """The same split from fewer, larger buckets."""
    parts = sampling.stratified_split(c.table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", bits=3)
    return parts.select("o_orderkey", "o_orderstatus", "part")


MANY_CLASSES = 1_500
MANY_SQL = f"SELECT o_orderkey AS key, o_orderkey % {MANY_CLASSES} AS class FROM orders"


def many_classes(spark, sf_dir):
    """Orders in 1,500 classes."""
    return c.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % MANY_CLASSES).alias("class"))


@query(f"""WITH rows AS ({MANY_SQL}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {c.hash_sql('key')}, key) AS rn FROM rows),
    sizes AS (SELECT class, count(*) AS n FROM rows GROUP BY 1),
    whole AS (SELECT class, n * t // total AS w, n * t % total AS rest, t FROM sizes, (SELECT ceil(sum(n) * 0.2)::BIGINT AS t, sum(n)::BIGINT AS total FROM sizes)),
    quota AS (SELECT class, w + CASE WHEN row_number() OVER (ORDER BY rest DESC, class) <= t - sum(w) OVER () THEN 1 ELSE 0 END AS q FROM whole)
    SELECT key, class, CASE WHEN rn <= q THEN 'test' ELSE 'train' END AS part FROM ranked JOIN quota USING (class)""")
def split_many_classes(spark, sf_dir):
    return sampling.stratified_split(many_classes(spark, sf_dir), "class", "key")


@query(f"SELECT key, class, (ntile(5) OVER (PARTITION BY class ORDER BY {c.hash_sql('key')}, key) - 1)::INTEGER AS fold FROM ({MANY_SQL})")
def folds_many_classes(spark, sf_dir):
    return sampling.stratified_folds(many_classes(spark, sf_dir), "class", "key")


@query(
    f"SELECT o_orderkey, CASE WHEN {c.hash_sql('o_orderkey')} / 4503599627370496 < 0.2 THEN 'test' ELSE 'train' END AS part FROM orders"
)
def threshold_split(spark, sf_dir):
    parts = sampling.stratified_split(c.table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey", exact=False)
    return parts.select("o_orderkey", "part")


FOLDS_SQL = f"""folds AS (SELECT *, (ntile(5) OVER (PARTITION BY label ORDER BY {c.hash_sql('o_orderkey')}, o_orderkey) - 1)::INTEGER AS fold
    FROM ({c.SCORED_SQL}))"""


@query(f"WITH {FOLDS_SQL} SELECT o_orderkey, label, fold FROM folds")
def stratified_folds(spark, sf_dir):
    folds = sampling.stratified_folds(c.scored_orders(spark, sf_dir), "label", "o_orderkey")
    return folds.select("o_orderkey", "label", "fold")


@query(f"SELECT o_orderkey FROM orders WHERE {c.hash_sql('o_orderkey')} / 4503599627370496 < 0.1")
def fraction_sample(spark, sf_dir):
    return sampling.fraction_sample(c.table(spark, sf_dir, "orders"), 0.1, "o_orderkey").select("o_orderkey")


@query(f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {c.hash_sql('o_orderkey')}, o_orderkey LIMIT 100")
def fixed_sample(spark, sf_dir):
    return sampling.fixed_sample(c.table(spark, sf_dir, "orders"), 100, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey = 100")
def row_by_key(spark, sf_dir):
    row = mapping.row_by_key(c.table(spark, sf_dir, "orders"), "o_orderkey", 100)
    return row.select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("""
SELECT o_orderkey + 9007199254740992 AS large_key, o_orderstatus FROM orders ORDER BY 1 LIMIT 1 OFFSET 101
""")
def row_at_large_key(spark, sf_dir):
    """Keys above 2^53, where neighbours share a double."""
    orders = c.table(spark, sf_dir, "orders").select((F.col("o_orderkey") + F.lit(2**53)).alias("large_key"), "o_orderstatus")
    return mapping.row_at(orders, "large_key", 101)


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 100")
def row_at_position(spark, sf_dir):
    row = mapping.row_at(c.table(spark, sf_dir, "orders"), "o_orderkey", 100)
    return row.select("o_orderkey", "o_totalprice", "o_orderstatus")


# --- metrics ---------------------------------------------------------------------------------------------------------


def _metrics_ctes(label: str, prediction: str, source: str, by: str = "") -> str:
    """cells, classes and totals of a scored source, optionally per group."""
    group = f"{by}, " if by else ""
    on = f"a.{by} = b.{by} AND " if by else ""
    pick = f"coalesce(a.{by}, b.{by}) AS {by}, " if by else ""
    return f"""
cells AS (SELECT {group}{label} AS label, {prediction} AS prediction, count(*) AS n FROM {source} GROUP BY ALL),
truth AS (SELECT {group}label AS class, sum(n) AS support, sum(n) FILTER (WHERE label = prediction) AS hits FROM cells GROUP BY ALL),
guess AS (SELECT {group}prediction AS class, sum(n) AS predicted FROM cells GROUP BY ALL),
classes AS (
  SELECT {pick}coalesce(a.class, b.class) AS class, coalesce(support, 0)::BIGINT AS support, coalesce(hits, 0)::BIGINT AS hits,
         coalesce(predicted, 0)::BIGINT AS predicted
  FROM truth a FULL JOIN guess b ON {on}a.class = b.class
),
per_class AS (
  SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
         coalesce(2 * hits / nullif(predicted + support, 0), 0) AS f1 FROM classes
),
totals AS (
  SELECT {group}sum(hits) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision,
         sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1, sum(support)::BIGINT AS rows,
         avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1
  FROM per_class {"GROUP BY " + by if by else ""}
)"""


BINARY_SQL = _metrics_ctes("label", "prediction", f"({c.SCORED_SQL})")
MULTI_SQL = _metrics_ctes("o_orderstatus", "guess", f"({c.SCORED_SQL})")
GRID_SQL = """grid AS (SELECT a.class AS label, b.class AS prediction, coalesce(n, 0) AS n
    FROM classes a CROSS JOIN classes b LEFT JOIN cells ON cells.label = a.class AND cells.prediction = b.class)"""
ROUNDED = "round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


def rounded(df, *columns):
    return df.withColumns({n: F.round(n, 6) for n in columns})


def status_counts(spark, sf_dir):
    return evaluation.confusion_counts(c.scored_orders(spark, sf_dir), "o_orderstatus", "guess")


@query(f"WITH {MULTI_SQL}, {GRID_SQL} SELECT * FROM grid")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion_matrix(status_counts(spark, sf_dir))


@query(
    f"WITH {MULTI_SQL}, {GRID_SQL} SELECT label, prediction, n, "
    "round(coalesce(n / nullif(sum(n) OVER (PARTITION BY label), 0), 0), 6) AS share FROM grid"
)
def confusion_normalized(spark, sf_dir):
    return rounded(evaluation.normalized_confusion(status_counts(spark, sf_dir)), "share")


@query(f"WITH {MULTI_SQL} SELECT {ROUNDED}, rows FROM totals")
def accuracy_weighted(spark, sf_dir):
    return rounded(evaluation.summary_metrics(status_counts(spark, sf_dir)), *evaluation.METRICS)


@query(
    f"""SELECT round(2 * tp / (2 * tp + fp + fn), 6) AS f1, tp, fp, fn FROM (
    SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
           count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM ({c.SCORED_SQL}))"""
)
def binary_f1(spark, sf_dir):
    return rounded(evaluation.binary_f1(evaluation.confusion_counts(c.scored_orders(spark, sf_dir))), "f1")


@query(
    f"""WITH {MULTI_SQL}
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per_class
    UNION ALL SELECT 'accuracy', NULL, NULL, round(accuracy, 6), rows FROM totals
    UNION ALL SELECT 'macro avg', round(macro_precision, 6), round(macro_recall, 6), round(macro_f1, 6), rows FROM totals
    UNION ALL SELECT 'weighted avg', round(precision, 6), round(recall, 6), round(f1, 6), rows FROM totals"""
)
def classification_report(spark, sf_dir):
    return rounded(evaluation.classification_report(status_counts(spark, sf_dir)), "precision", "recall", "f1")


@query(
    f"""WITH {FOLDS_SQL}, {_metrics_ctes("label", "prediction", "folds", "fold")}
    SELECT round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std,
           round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_std FROM totals"""
)
def cv_summary(spark, sf_dir):
    folds = sampling.stratified_folds(c.scored_orders(spark, sf_dir), "label", "o_orderkey")
    summary = evaluation.cross_validation_summary(folds, "label", "prediction")
    return rounded(summary, *summary.columns)


RULES = {"loose": "prediction", "lenient": "lenient_rule", "strict": "strict_rule"}
RULES_SQL = " UNION ALL ".join(f"SELECT '{m}' AS model, label, {p} AS prediction FROM ({c.SCORED_SQL})" for m, p in RULES.items())


@query(f"""WITH {_metrics_ctes("label", "prediction", f"({RULES_SQL})", "model")} SELECT model, {ROUNDED}, rows FROM totals""")
def model_comparison(spark, sf_dir):
    compared = evaluation.compare_models(c.scored_orders(spark, sf_dir), "label", RULES)
    return rounded(compared, *evaluation.METRICS)


@query(
    """WITH sizes AS (SELECT o_orderstatus AS label, count(*) AS rows FROM orders GROUP BY 1)
    SELECT label, rows, round((SELECT sum(rows) FROM sizes) / ((SELECT count(*) FROM sizes) * rows), 6) AS weight FROM sizes"""
)
def class_weights(spark, sf_dir):
    return rounded(evaluation.class_weights(c.table(spark, sf_dir, "orders"), "o_orderstatus"), "weight")


@query(
    "SELECT o_orderkey, greatest(least(o_totalprice / 500000, 1.0::DOUBLE), 1 - least(o_totalprice / 500000, 1.0::DOUBLE)) AS confidence FROM orders"
)
def prediction_confidence(spark, sf_dir):
    p = F.least(F.col("o_totalprice") / 500000, F.lit(1.0))
    vector = array_to_vector(F.array(p, 1 - p))
    return c.table(spark, sf_dir, "orders").select("o_orderkey", evaluation.confidence(vector).alias("confidence"))


# --- preprocessing ---------------------------------------------------------------------------------------------------

NUMBERS = ["l_quantity", "l_extendedprice", "l_tax"]
CATEGORIES = ["l_returnflag", "l_linestatus"]
HOLED_SQL = """holed AS (SELECT l_shipdate, nullif(l_quantity, 25) AS l_quantity, l_extendedprice, nullif(l_tax, 0) AS l_tax,
    nullif(l_returnflag, 'R') AS l_returnflag, l_linestatus FROM lineitem)"""
FIT_SQL = "(SELECT * FROM holed WHERE l_shipdate < TIMESTAMP '1997-01-01')"


def holed(spark, sf_dir):
    """lineitem with gaps; the return flag R never occurs."""
    return c.table(spark, sf_dir, "lineitem").withColumns(
        {
            "l_quantity": F.nullif(F.col("l_quantity"), F.lit(25.0)),
            "l_tax": F.nullif(F.col("l_tax"), F.lit(0.0)),
            "l_returnflag": F.nullif(F.col("l_returnflag"), F.lit("R")),
        }
    )


def fitted(spark, sf_dir, numbers=NUMBERS, categories=CATEGORIES):
    """Fitted on the early rows, so that later tables can hold categories it has not seen."""
    rows = holed(spark, sf_dir)
    return FlowPreprocessor(categories, numbers).fit(rows.where(F.col("l_shipdate") < F.lit(c.SPLIT).cast("timestamp_ntz")))


def _mode_sql(column: str) -> str:
    return f"(SELECT {column} FROM {FIT_SQL} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _median_sql(column: str) -> str:
    return f"(SELECT quantile_cont({column}, 0.5) FROM {FIT_SQL})"


def _filled_sql(column: str) -> str:
    return f"coalesce({column}, {_median_sql(column) if column in NUMBERS else _mode_sql(column)})"


def _scaled_sql(column: str) -> str:
    filled = f"(SELECT coalesce({column}, {_median_sql(column)}) AS v FROM {FIT_SQL})"
    return f"round((coalesce({column}, {_median_sql(column)}) - (SELECT avg(v) FROM {filled})) / (SELECT stddev_pop(v) FROM {filled}), 6) + 0.0"


@query(f"WITH {HOLED_SQL} SELECT " + ", ".join(f"{_filled_sql(n)} AS {n}" for n in [*NUMBERS, *CATEGORIES]) + " FROM holed")
def median_mode_impute(spark, sf_dir):
    return holed(spark, sf_dir).select(*fitted(spark, sf_dir).imputed())


# the raw table holds the flag R, which the fitted rows lack: it encodes to zeros
FLAGS = {"l_returnflag": ("A", "N"), "l_linestatus": ("F", "O")}
ONE_HOT_SQL = ", ".join(
    f"CASE WHEN {n} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {n}_{v}" for n, vs in FLAGS.items() for v in vs
)


@query(f"SELECT {ONE_HOT_SQL} FROM lineitem")
def one_hot(spark, sf_dir):
    model = fitted(spark, sf_dir, numbers=[])
    return c.table(spark, sf_dir, "lineitem").select(*model.encoded())


@query(f"WITH {HOLED_SQL} SELECT " + ", ".join(f"{_scaled_sql(n)} AS {n}" for n in NUMBERS) + " FROM holed")
def standardize(spark, sf_dir):
    scaled = holed(spark, sf_dir).select(*fitted(spark, sf_dir, categories=[]).scaled())
    return scaled.select(*[(F.round(n, 6) + 0.0).alias(n) for n in NUMBERS])


@query(
    f"WITH {HOLED_SQL}, filled AS (SELECT * REPLACE ({_mode_sql('l_returnflag')} AS l_returnflag) FROM holed WHERE l_returnflag IS NULL "
    f"UNION ALL SELECT * FROM holed WHERE l_returnflag IS NOT NULL) SELECT {ONE_HOT_SQL}, "
    + ", ".join(f"{_scaled_sql(n)} AS {n}" for n in NUMBERS)
    + " FROM filled"
)
def feature_matrix(spark, sf_dir):
    matrix = fitted(spark, sf_dir).transform(holed(spark, sf_dir))
    return matrix.select(*[(F.round(n, 6) + 0.0).alias(n) for n in matrix.columns])


@query(
    f"WITH {HOLED_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round({_median_sql(n)}, 6) AS median, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS scale "
        f"FROM (SELECT coalesce({n}, {_median_sql(n)}) AS v FROM {FIT_SQL})"
        for n in NUMBERS
    )
)
def preprocessor_state(spark, sf_dir):
    state = fitted(spark, sf_dir, categories=[]).to_df(spark)
    return rounded(state.select("feature", "median", "mean", "scale"), "median", "mean", "scale")


# --- models: rows only -----------------------------------------------------------------------------------------------


def order_parts(spark, sf_dir):
    """(fit, test, all) vectors of "is the order finished", from its customer, month, priority and price.

    Models and the preprocessor see at most ``FIT_ROWS`` training rows; ``all`` has the part of every row.
    """
    parts = sampling.stratified_split(c.order_features(spark, sf_dir), "label", "o_orderkey")
    rows = written(c.fit_rows(parts.where("part = 'train'")), "fit-rows")
    model = FlowPreprocessor([], c.ORDER_FEATURES, ["o_orderkey", "label", "part"]).fit(rows)
    every = model.with_vector(parts)
    return model.with_vector(rows).drop("part"), every.where("part = 'test'").drop("part"), every


def held_out_metrics(estimator, parts, balanced=False):
    """Metrics on rows that the fitted model has not seen."""
    train, test, _ = parts
    counts = evaluation.confusion_counts(models.score(models.train(estimator, train, balanced=balanced), test, ["label"]))
    return evaluation.summary_metrics(counts)


@query()
def train_lr(spark, sf_dir):
    parts = order_parts(spark, sf_dir)
    return held_out_metrics(models.logistic_regression(parts[0].count()), parts)


@query()
def train_rf(spark, sf_dir):
    return held_out_metrics(models.random_forest(), order_parts(spark, sf_dir), balanced=True)


def boosted_orders(spark, sf_dir):
    """The preset (300 rounds of 31 leaves) on at most ``FIT_ROWS`` training rows, and all rows with their part."""
    parts = sampling.stratified_split(c.order_features(spark, sf_dir).drop("prediction", "confidence"), "label", "o_orderkey")
    return boosting.fit(c.fit_rows(parts.where("part = 'train'")), c.ORDER_FEATURES, "label", "o_orderkey"), parts


@query()
def train_gbt(spark, sf_dir):
    model, parts = boosted_orders(spark, sf_dir)
    scored = model.score(parts.where("part = 'test'"), ["label"])
    return evaluation.summary_metrics(evaluation.confusion_counts(scored))


@query(
    f"""SELECT 300::BIGINT AS trees, true AS leaves_fit, true AS rows_kept, true AS loss_falls, true AS leaf_rows, count(*) AS scored FROM orders"""
)
def boosting_facts(spark, sf_dir):
    """What holds for any fitted model: trees, at most 31 leaves of at least 20 rows, children's rows are the parent's, falling loss."""
    model, parts = boosted_orders(spark, sf_dir)
    path = scratch_path(spark, "boosted")
    model.save(path)
    model = boosting.BoostedModel.load(spark, path)
    nodes = model.nodes
    inner = nodes.where("left >= 0").select("tree", F.col("id").alias("up"), F.explode(F.array("left", "right")).alias("id"), F.col("rows").alias("whole"))
    sums = inner.join(nodes.select("tree", "id", "rows"), ["tree", "id"]).groupBy("tree", "up", "whole").agg(F.sum("rows").alias("rows"))
    trees = nodes.groupBy("tree").agg(F.count_if(F.col("left") < 0).alias("leaves"), F.min(F.when(F.col("left") < 0, F.col("rows"))).alias("least"), F.max("loss").alias("loss"))
    loss = Window.partitionBy(F.lit(0)).orderBy("tree")
    falls = trees.withColumn("rise", F.col("loss") - F.lag("loss", 25).over(loss))
    facts = falls.agg(
        F.count("*").alias("trees"), (F.max("leaves") <= 31).alias("leaves_fit"), F.coalesce(F.max("rise") < 0, F.lit(False)).alias("loss_falls"), (F.min("least") >= 20).alias("leaf_rows")
    )
    kept = sums.agg(F.coalesce(F.bool_and(F.col("rows") == F.col("whole")), F.lit(True)).alias("rows_kept"))
    scored = model.score(parts, ["o_orderkey"]).agg(F.count_if(F.col("probability").between(0, 1)).alias("scored"))
    return facts.join(F.broadcast(kept)).join(F.broadcast(scored)).select("trees", "leaves_fit", "rows_kept", "loss_falls", "leaf_rows", "scored")


@query()
def score_batch(spark, sf_dir):
    """Every order, by a forest and a preprocessor that know training rows only."""
    fit, _, every = order_parts(spark, sf_dir)
    return models.score(models.train(models.random_forest(), fit), every, ["o_orderkey"]).select("o_orderkey", "prediction", "confidence")


@query()
def train_many(spark, sf_dir):
    fit, test, _ = order_parts(spark, sf_dir)
    chosen = {"logistic_regression": models.logistic_regression(fit.count()), "random_forest": models.random_forest()}
    scored = models.score_many(models.train_many(chosen, fit, "orders"), test)
    return evaluation.summary_metrics(evaluation.confusion_counts(scored, by=["model"]), ["model"])


@query()
def evaluate_model(spark, sf_dir):
    fit, test, _ = order_parts(spark, sf_dir)
    return models.evaluate(models.train(models.random_forest(), fit), test)[1]


PARTS_SQL = f"""parts AS (SELECT *, CASE WHEN rn <= q THEN 'test' ELSE 'train' END AS part FROM (
    SELECT o_orderkey, label, row_number() OVER (PARTITION BY label ORDER BY {c.hash_sql('o_orderkey')}, o_orderkey) AS rn FROM ({c.SCORED_SQL})) JOIN (
    SELECT label, w + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= t - sum(w) OVER () THEN 1 ELSE 0 END AS q FROM (
      SELECT label, n * t // total AS w, n * t % total AS rest, t FROM (SELECT label, count(*) AS n FROM ({c.SCORED_SQL}) GROUP BY 1),
      (SELECT ceil(count(*) * 0.2)::BIGINT AS t, count(*) AS total FROM orders))) USING (label))"""


@query(f"WITH {PARTS_SQL} SELECT part, count(*) AS rows, true AS shares FROM parts GROUP BY part")
def metrics_by_part(spark, sf_dir):
    """Metrics records that say which part of the split they are of; accuracy and f1 are shares."""
    fit, _, every = order_parts(spark, sf_dir)
    found = models.evaluate_parts(models.train(models.logistic_regression(fit.count()), fit), every)
    return found.select("part", "rows", (F.col("accuracy").between(0, 1) & F.col("f1").between(0, 1)).alias("shares"))


@query(f"""WITH {FOLDS_SQL} SELECT fold, label, count(*) AS rows FROM folds GROUP BY ALL""")
def cross_validated_rows(spark, sf_dir):
    """Every row is predicted once, by the unit that did not see its fold."""
    folded, unit = _folded_orders(spark, sf_dir)
    return models.cross_validate(unit, folded).groupBy("fold", F.col("label").cast("int").alias("label")).agg(F.count("prediction").alias("rows"))


def _folded_orders(spark, sf_dir):
    """Orders with folds, and preprocessor and model as one unit."""
    folded = written(sampling.stratified_folds(c.order_features(spark, sf_dir).drop("prediction", "confidence"), "label", "o_orderkey"), "folds")
    return folded, Pipeline(stages=[FlowPreprocessor([], c.ORDER_FEATURES, vector="features"), models.logistic_regression(folded.count())])


@query()
def cross_validate_model(spark, sf_dir):
    folded, unit = _folded_orders(spark, sf_dir)
    return evaluation.cross_validation_summary(models.cross_validate(unit, folded), "label", "prediction")


@query("SELECT true AS same, count(*) AS rows FROM orders")
def pipeline_store(spark, sf_dir):
    """Preprocessor and model fitted, saved and loaded as one unit agree with the original on every order."""
    rows = c.order_features(spark, sf_dir).drop("prediction", "confidence").withColumn("band", F.floor("priority").cast("string"))
    unit = Pipeline(stages=[FlowPreprocessor(["band"], c.ORDER_FEATURES, vector="features"), models.logistic_regression(c.FIT_ROWS)])
    model, path = unit.fit(c.fit_rows(rows)), scratch_path(spark, "unit")
    sinks.save_model(model, path)
    first = model.transform(rows).select(*rows.columns, F.col("prediction").alias("original"))
    both = PipelineModel.load(path).transform(first)
    return both.groupBy((F.col("original") == F.col("prediction")).alias("same")).agg(F.count("*").alias("rows"))


# --- many classes and categories -------------------------------------------------------------------------------------

MANY_CATEGORIES = 3_000


@query(
    f"""WITH rows AS (SELECT o_orderkey, (o_orderkey % {MANY_CATEGORIES})::VARCHAR AS category FROM orders),
    known AS (SELECT category, dense_rank() OVER (ORDER BY category) AS place FROM (SELECT DISTINCT category FROM rows WHERE o_orderkey % 7 <> 0))
    SELECT o_orderkey, coalesce(place, 0)::BIGINT AS place, (SELECT count(*) FROM known)::INTEGER AS size FROM rows LEFT JOIN known USING (category)"""
)
def one_hot_many(spark, sf_dir):
    """3,000 categories as a sparse vector: the place of its one, 0 for a category that was not fitted."""
    rows = c.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % MANY_CATEGORIES).cast("string").alias("category"))
    vectors = FlowPreprocessor(["category"], [], ["o_orderkey"]).fit(rows.where("o_orderkey % 7 <> 0")).with_vector(rows)
    flags = vector_to_array("features")
    return vectors.select("o_orderkey", F.array_position(flags, F.lit(1.0)).alias("place"), F.size(flags).alias("size"))


GUESS = "CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 1500 END"
MANY_METRICS_SQL = _metrics_ctes("label", "prediction", f"(SELECT o_orderkey % 1500 AS label, {GUESS} AS prediction FROM orders)")


def many_counts(spark, sf_dir):
    scored = c.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % MANY_CLASSES).alias("label"), F.expr(GUESS).alias("prediction"))
    return evaluation.confusion_counts(scored)


@query(
    f"""WITH {MANY_METRICS_SQL}
    SELECT class::VARCHAR AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per_class
    UNION ALL SELECT 'accuracy', NULL, NULL, round(accuracy, 6), rows FROM totals
    UNION ALL SELECT 'macro avg', round(macro_precision, 6), round(macro_recall, 6), round(macro_f1, 6), rows FROM totals
    UNION ALL SELECT 'weighted avg', round(precision, 6), round(recall, 6), round(f1, 6), rows FROM totals"""
)
def report_many_classes(spark, sf_dir):
    return rounded(evaluation.classification_report(many_counts(spark, sf_dir)), "precision", "recall", "f1")


@query(f"WITH {MANY_METRICS_SQL}, {GRID_SQL} SELECT label, count(*) AS cells, sum(n)::BIGINT AS rows FROM grid GROUP BY label")
def grid_many_classes(spark, sf_dir):
    grid = evaluation.confusion_matrix(many_counts(spark, sf_dir))
    return grid.groupBy("label").agg(F.count("*").alias("cells"), F.sum("n").alias("rows"))


@query(
    f"""SELECT o_orderkey, round((SELECT count(*) FROM orders) / ((SELECT count(DISTINCT o_orderkey % {MANY_CLASSES}) FROM orders) * count(*) OVER (PARTITION BY o_orderkey % {MANY_CLASSES})), 6) AS weight
    FROM orders"""
)
def weights_many_classes(spark, sf_dir):
    rows = c.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % MANY_CLASSES).alias("class"))
    return rounded(evaluation.with_class_weights(rows, "class").select("o_orderkey", "weight"), "weight")
