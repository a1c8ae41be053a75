"""Data model: record ids, table schemas, and the additive schema registry."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The eight core edge types and their end points.
EDGE_ENDS = {
    "tagged": ("memory", "tag"),
    "owned_by": ("memory", "domain"),
    "reinforces": ("memory", "memory"),
    "contradicts": ("memory", "memory"),
    "summarizes": ("memory", "memory"),
    "refines": ("memory", "memory"),
    "child_of": ("tag", "tag"),
    "has_rule": ("domain", "memory"),
}
REFERENCE_EDGES = ("reinforces", "contradicts", "summarizes", "refines")

SCHEMAS = {
    "memory": "id string, content string, embedding array<float>, event_time bigint, created_at bigint, token_count bigint, "
    "request_context string, structured_data string, metadata string, answers_question string, classification string, "
    "topics array<string>, name_normalized string",
    "tag": "id string, label string, created_at bigint",
    "domain": "id string, name string, settings string",
    "meta": "id string, value string",
    "event": "id string, name string, memory_id string, domain string, at bigint",
    "failure": "batch_key string, stage string, domain string, ids array<string>, name string, error string, at bigint",
    "edges": "edge_type string, id string, in_id string, out_id string, attributes string, owned_at bigint, strength double, "
    "detected_at bigint, relationship string, relevance double, domain string",
    "claim": "id string, text string, embedding array<float>, tokens array<string>, valid_from bigint, valid_to bigint, supersedes string",
}

# Declared field types and their Spark types.
FIELD_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "int": T.LongType(), "integer": T.LongType(), "number": T.DoubleType(), "float": T.DoubleType(),
    "decimal": T.DecimalType(38, 18), "bool": T.BooleanType(), "boolean": T.BooleanType(), "bytes": T.BinaryType(),
    "object": T.VariantType(), "record": T.StringType(), "datetime": T.TimestampType(), "duration": T.DayTimeIntervalType(),
}
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class SchemaConflict(ValueError):
    """A field was declared again with another type."""


def field_type(declared: str) -> T.DataType:
    """Spark type of a declared field type; unknown ones are VARIANT."""
    declared = declared.strip()
    if m := re.fullmatch(r"option<(.+)>", declared):
        return field_type(m[1])
    if m := re.fullmatch(r"(?:array|set)<(.+)>", declared):
        return T.ArrayType(field_type(m[1]))
    if re.fullmatch(r"record<.+>", declared):
        return T.StringType()
    if re.fullmatch(r"vector\(\d+\)", declared):
        return T.ArrayType(T.FloatType(), False)
    return FIELD_TYPES.get(declared, T.VariantType())


class SchemaRegistry:
    """Tables that plugins may extend: new fields are added, equal ones pass, other types conflict."""

    def __init__(self) -> None:
        self.tables: dict[str, dict[str, str]] = {}
        self.required: dict[str, set[str]] = {}

    def register(self, table: str, fields: dict[str, str], required: tuple[str, ...] = ()) -> None:
        for name in (table, *fields):
            if not IDENTIFIER.fullmatch(name):
                raise ValueError(f"not an identifier: {name!r}")
        known = self.tables.setdefault(table, {})
        for name, declared in fields.items():
            if known.get(name, declared) != declared:
                raise SchemaConflict(f"{table}.{name} is {known[name]}, not {declared}")
        known.update(fields)
        needs = {n for n in required if not known[n].startswith("option<")}
        self.required.setdefault(table, set()).update(needs)

    def schema(self, table: str) -> T.StructType:
        return T.StructType(
            [T.StructField(n, field_type(d), n not in self.required[table]) for n, d in self.tables[table].items()]
        )

    def align(self, table: str, rows: DataFrame) -> DataFrame:
        """``rows`` with columns of the registered table, null where they were missing."""
        return rows.select(
            *[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema(table)]
        )


def record_id(table: str, key: Column) -> Column:
    return F.concat(F.lit(f"{table}:"), key.cast("string"))


def table_of(record: Column) -> Column:
    """The table that an id's prefix names; null if it has none."""
    return F.when(record.contains(":"), F.substring_index(record, ":", 1))


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])
