"""Contract loading, schema work, data quality and table profiles."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from tidegauge.contract import UniversalSchema
from tidegauge.operators import mapping, quality
from tidegauge.plans.load import load_flows, to_flows
from tidegauge.sources.readers import Catalog, table_profile
from workload import common as c

QUERIES, ORACLE = {}, {}


def query(sql=None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


LINEITEM_SQL = """SELECT l_quantity AS flow_duration, l_extendedprice AS src_bytes, l_tax AS dst_bytes, l_linestatus AS protocol,
    CASE WHEN l_returnflag = 'N' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label FROM lineitem"""

EVENTS_SQL = """SELECT value AS flow_duration, TRY_CAST(props AS DOUBLE) AS src_bytes, 0.0::DOUBLE AS dst_bytes,
    'unknown' AS protocol, CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label FROM events"""


@query(LINEITEM_SQL)
def contract_load_lineitem(spark, sf_dir):
    return load_flows(c.table(spark, sf_dir, "lineitem"), c.LINEITEM_FLOWS)


@query(EVENTS_SQL)
def contract_load_events(spark, sf_dir):
    return load_flows(c.table(spark, sf_dir, "events"), c.EVENTS_FLOWS)


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS label, value AS flow_duration, props AS src_bytes FROM events")
def contract_map_events(spark, sf_dir):
    mapped = mapping.map_columns(c.table(spark, sf_dir, "events"), c.EVENTS_FLOWS)
    return mapped.select("event_id", "label", "flow_duration", "src_bytes")


ORDER_SCHEMA = UniversalSchema({"o_totalprice": "float", "o_custkey": "int", "protocol": "category"}, "o_orderstatus")


@query("SELECT o_totalprice, o_custkey, 'unknown' AS protocol, o_orderstatus FROM orders")
def schema_strict(spark, sf_dir):
    return mapping.validate_schema(c.table(spark, sf_dir, "orders"), ORDER_SCHEMA, require_label=True)


@query("SELECT o_orderkey, o_totalprice, o_custkey FROM orders")
def feature_align(spark, sf_dir):
    return mapping.align_features(c.table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus AS __label__ FROM orders")
def normalized_columns(spark, sf_dir):
    names = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]
    padded = c.table(spark, sf_dir, "orders").select(*names).toDF(*[f"  {n} " for n in names])
    return mapping.normalize_columns(padded, " o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def label_side(spark, sf_dir):
    features, labels = mapping.split_features_label(c.table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderkey")
    assert "o_orderstatus" not in features.columns
    return labels


@query(
    """SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_totalprice::VARCHAR AS o_totalprice,
    o_orderdate::VARCHAR AS o_orderdate, o_orderpriority FROM orders"""
)
def cast_all_string(spark, sf_dir):
    return mapping.cast_all_string(c.table(spark, sf_dir, "orders"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def numeric_columns(spark, sf_dir):
    return mapping.select_numeric(c.table(spark, sf_dir, "lineitem"))


@query("SELECT event_type, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS label, count(*) AS n FROM events GROUP BY 1, 2")
def label_binarise(spark, sf_dir):
    events = c.table(spark, sf_dir, "events")
    label = mapping.binary_label(F.col("event_type"), c.EVENTS_FLOWS).alias("label")
    return events.groupBy("event_type", label).agg(F.count("*").alias("n"))


def _report_sql(flows: str, limit: float) -> str:
    missing = " + ".join(
        f"CASE WHEN {n} IS NULL THEN 1 ELSE 0 END" for n in ("flow_duration", "src_bytes", "dst_bytes", "protocol", "label")
    )
    return f"""WITH facts AS (SELECT count(*)::DOUBLE AS n, avg({missing}) / 5 AS ratio FROM ({flows}))
    SELECT 'rows' AS "check", n AS value, 1.0::DOUBLE AS "limit", n >= 1 AS passed FROM facts
    UNION ALL SELECT 'missing', ratio, {limit}::DOUBLE, ratio <= {limit}::DOUBLE FROM facts
    UNION ALL SELECT 'labels', 0.0::DOUBLE, 0.0::DOUBLE, true FROM facts
    UNION ALL SELECT 'columns', 0.0::DOUBLE, 0.0::DOUBLE, true FROM facts"""


@query(_report_sql(LINEITEM_SQL, 0.1))
def quality_report(spark, sf_dir):
    return quality.quality_report(to_flows(c.table(spark, sf_dir, "lineitem"), c.LINEITEM_FLOWS), c.LINEITEM_FLOWS)


@query(_report_sql(EVENTS_SQL, 0.1))
def quality_report_strict(spark, sf_dir):
    strict = replace(c.EVENTS_FLOWS, max_missing_pct=0.1)
    return quality.quality_report(to_flows(c.table(spark, sf_dir, "events"), strict), strict)


@query("SELECT l_returnflag AS label, count(*) AS rows FROM lineitem WHERE l_returnflag NOT IN ('N', 'A') GROUP BY 1")
def label_domain_violations(spark, sf_dir):
    raw = replace(c.LINEITEM_FLOWS, label_values=("N", "A"))
    return quality.label_violations(c.table(spark, sf_dir, "lineitem"), raw, "l_returnflag")


HOLES = {"l_quantity": 25, "l_tax": 0, "l_linenumber": 3}


@query(
    "SELECT count(*) AS rows, round((avg(CASE WHEN l_quantity = 25 THEN 1 ELSE 0 END) + avg(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END) "
    "+ avg(CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END)) / 3, 6) AS missing_ratio FROM lineitem"
)
def missing_ratio(spark, sf_dir):
    holed = c.table(spark, sf_dir, "lineitem").select(*[F.nullif(F.col(n), F.lit(v)).alias(n) for n, v in HOLES.items()])
    return quality.missing_ratio(holed).withColumn("missing_ratio", F.round("missing_ratio", 6))


COLUMNS = {
    "region": "r_regionkey,r_name",
    "nation": "n_nationkey,n_name,n_regionkey",
    "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
    "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
    "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
    "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "lineitem": (
        "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,"
        "l_linestatus,l_shipdate"
    ),
    "events": "event_id,ts,user_id,event_type,value,props",
    "documents": "doc_id,text,lang,source,n_chars",
    "embeddings": "vec_id,embedding,label",
    "pages": "page_id,url,html",
    "benchmark": "item_id,text",
    "labels": "doc_id,quality,toxic",
    "conversations": "conv_id,turn,role,text",
}


@query(
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{names}' AS column_names, {names.count(",") + 1}::INTEGER AS column_count, 1::BIGINT AS parts,
        count(*) AS total_rows FROM {t}"""
        for t, names in COLUMNS.items()
    )
)
def table_profiles(spark, sf_dir):
    catalog = Catalog.parquet_folder(sf_dir, list(COLUMNS))
    return reduce(lambda a, b: a.unionByName(b), [table_profile(catalog.load(spark, t), t) for t in COLUMNS])
