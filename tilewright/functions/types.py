"""Type buckets of attribute columns."""

from __future__ import annotations

from pyspark.sql import types as T


def type_bucket(dtype: T.DataType) -> str:
    """string, numeric, boolean, datetime or unknown: decides literal coercion."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "unknown"


def tilejson_type(dtype: T.DataType) -> str:
    return {"numeric": "Number", "boolean": "Boolean"}.get(type_bucket(dtype), "String")
