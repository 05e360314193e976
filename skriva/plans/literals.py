"""Small tables written out once, for a query and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL_TYPES = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<array<string>>": "VARCHAR[][]", "array<double>": "DOUBLE[]"}


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    if isinstance(value, list):
        return "[" + ", ".join(map(literal, value)) + "]"
    return repr(value)


def values(rows: list[tuple], schema: str, name: str) -> str:
    """The rows as a common table expression."""
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    columns = ", ".join(f"c{i}::{SQL_TYPES[kind]} AS {n}" for i, (n, kind) in enumerate(fields))
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"{name} AS (SELECT {columns} FROM (VALUES {body}) v({', '.join(f'c{i}' for i in range(len(fields)))}))"
