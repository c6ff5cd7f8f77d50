"""Dataset contracts and the universal schema. Both are small driver-side metadata."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from tidegauge.errors import ContractError, SchemaError

CATEGORY = "category"
NUMBERS = ("int", "float")


@dataclass(frozen=True)
class UniversalSchema:
    """Ordered features with their logical type (int, float or category) and the label column."""

    features: Mapping[str, str]
    label: str = "label"
    version: str = "v1"

    @property
    def feature_names(self) -> list[str]:
        return list(self.features)

    @property
    def categories(self) -> list[str]:
        return [name for name, kind in self.features.items() if kind == CATEGORY]

    @property
    def numbers(self) -> list[str]:
        return [name for name, kind in self.features.items() if kind in NUMBERS]

    def struct(self) -> T.StructType:
        """Spark schema; the logical type is kept in the field metadata. Numbers are doubles, as raw values may be NULL."""
        fields = [
            T.StructField(n, T.StringType() if k == CATEGORY else T.DoubleType(), True, {"logical_type": k})
            for n, k in self.features.items()
        ]
        return T.StructType([*fields, T.StructField(self.label, T.DoubleType(), True, {"logical_type": "binary"})])

    @staticmethod
    def from_dict(spec: Mapping[str, Any], label: str | None = None) -> UniversalSchema:
        unknown = set(spec["features"].values()) - {CATEGORY, *NUMBERS}
        if unknown:
            raise SchemaError(f"unknown logical types: {sorted(unknown)}")
        return UniversalSchema(
            dict(spec["features"]), label or spec["label"]["name"], str(spec.get("schema_version", "v1"))
        )

    @staticmethod
    def from_file(path: str, label: str | None = None) -> UniversalSchema:
        """Read a schema from JSON, or from YAML when a YAML reader is installed."""
        with open(path, encoding="utf-8") as file:
            text = file.read()
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as error:
                raise SchemaError("reading YAML schemas needs PyYAML; use JSON instead") from error
            return UniversalSchema.from_dict(yaml.safe_load(text), label)
        return UniversalSchema.from_dict(json.loads(text), label)


# The universal flow schema, version 1. The mapped label is called ``label`` throughout.
FLOW_SCHEMA = UniversalSchema(
    {"flow_duration": "float", "src_bytes": "int", "dst_bytes": "int", "protocol": "category"}, "label", "v1"
)


@dataclass(frozen=True)
class Contract:
    """How a raw dataset maps to the universal schema and what it must satisfy."""

    label_column: str
    column_aliases: Mapping[str, str] = field(default_factory=dict)
    label_mapping: Mapping[str, int] = field(default_factory=dict)
    max_missing_pct: float = 0.0
    label_values: tuple[Any, ...] = (0, 1)
    categorical_features: tuple[str, ...] = ()
    numeric_features: tuple[str, ...] = ()

    @property
    def benign_label(self) -> str:
        """The raw label that maps to 0; with several, the last one."""
        benign = [key for key, value in self.label_mapping.items() if value == 0]
        if not benign:
            raise ContractError("the contract maps no label to 0, so none is benign")
        return benign[-1]

    @property
    def required_columns(self) -> list[str]:
        return [*self.categorical_features, *self.numeric_features, "label"]

    @staticmethod
    def from_dict(spec: Mapping[str, Any]) -> Contract:
        known = {k: spec[k] for k in Contract.__dataclass_fields__ if k in spec and spec[k] is not None}
        for key in ("label_values", "categorical_features", "numeric_features"):
            if key in known:
                known[key] = tuple(known[key])
        return Contract(**known)

    @staticmethod
    def from_file(path: str) -> Contract:
        with open(path, encoding="utf-8") as file:
            return Contract.from_dict(json.load(file))
