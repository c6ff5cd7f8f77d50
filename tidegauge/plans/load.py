"""Contract loading: map, enforce, validate. One contract-driven plan for every dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidegauge.contract import FLOW_SCHEMA, Contract, UniversalSchema
from tidegauge.operators.mapping import enforce_schema, map_columns
from tidegauge.operators.quality import validate


def to_flows(raw: DataFrame, contract: Contract, schema: UniversalSchema = FLOW_SCHEMA) -> DataFrame:
    """Raw table to universal schema; lazy and unchecked."""
    return enforce_schema(map_columns(raw, contract), schema)


def load_flows(raw: DataFrame, contract: Contract, schema: UniversalSchema = FLOW_SCHEMA) -> DataFrame:
    """Raw table to universal schema, checked by one aggregate over the columns the schema needs.

    The batch form checks the whole table; the stream form checks each micro-batch.
    """
    return validate(to_flows(raw, contract, schema), contract, schema.label)
