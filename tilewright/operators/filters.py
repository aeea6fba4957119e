"""Safe attribute filters: a small predicate tree becomes one Column.

A predicate is plain JSON-like data::

    ["and", ["=", "status", "active"], ["or", ["in", "id", [1, 2]], ["not", ["is null", "name"]]]]

Column names are checked against the layer and literals are coerced to the type
of the column, so the filter cannot do more than compare attributes. The Column
holds no UDF: it is pushed down to the scan.
"""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.types import type_bucket
from tilewright.model import Layer

# fixed values: texts that never belong in a filter
KEYWORDS = ("SELECT", "UPDATE", "DELETE", "INSERT", "MERGE", "ALTER", "DROP", "CREATE", "GRANT", "REVOKE", "CALL",
            "EXECUTE", "WITH")
MARKS = (";", "--", r"/\*", r"\*/", r"\$\$", "::")
# words end at ASCII letters, digits and underscore only, whatever the regex engine's idea of a word is
FORBIDDEN = f"(?i)({'|'.join(MARKS)}|(?<![A-Za-z0-9_])({'|'.join(KEYWORDS)})(?![A-Za-z0-9_]))"
NUMBER = re.compile(r"-?\d+(\.\d+)?")
COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}


class InvalidFilter(ValueError):
    """A predicate that is malformed, names an unknown column or has a bad literal."""


def filter_layer(layer: Layer, predicate: Any) -> Layer:
    """The layer with only the rows that satisfy the predicate; ``None`` keeps all."""
    if predicate is None:
        return layer
    return layer.with_frame(layer.frame.filter(predicate_column(layer, predicate)))


def predicate_column(layer: Layer, predicate: Any) -> Column:
    types: dict[str, T.DataType] = dict(layer.fields)
    for g in layer.geometries:
        types[g.name] = layer.frame.schema[g.name].dataType
    return _build(predicate, types)


def audit_filters(texts: DataFrame, column: str = "filter") -> DataFrame:
    """Flag filter texts that carry statement keywords, comments or separators."""
    return texts.withColumn("forbidden", F.coalesce(F.col(column).rlike(FORBIDDEN), F.lit(False)))


def _build(node: Any, types: dict[str, T.DataType]) -> Column:
    if not isinstance(node, (list, tuple)) or not node or not isinstance(node[0], str):
        raise InvalidFilter(f"not a predicate: {node!r}")
    op, args = node[0].lower(), list(node[1:])
    if op in ("and", "or"):
        if not args:
            raise InvalidFilter(f"{op} needs at least one operand")
        out = _build(args[0], types)
        for arg in args[1:]:
            out = out & _build(arg, types) if op == "and" else out | _build(arg, types)
        return out
    if op == "not":
        _arity(op, args, 1)
        return ~_build(args[0], types)
    if op in ("is null", "is not null"):
        _arity(op, args, 1)
        column = F.col(_quoted(_resolve(args[0], types)))
        return column.isNull() if op == "is null" else column.isNotNull()
    if op in COMPARE:
        _arity(op, args, 2)
        name = _resolve(args[0], types)
        return COMPARE[op](F.col(_quoted(name)), _literal(name, types[name], args[1]))
    if op == "in":
        _arity(op, args, 2)
        name = _resolve(args[0], types)
        if not isinstance(args[1], (list, tuple)) or not args[1]:
            raise InvalidFilter("in needs a list of at least one literal")
        return F.col(_quoted(name)).isin(*[_literal(name, types[name], v) for v in args[1]])
    if op == "between":
        _arity(op, args, 3)
        name = _resolve(args[0], types)
        return F.col(_quoted(name)).between(*[_literal(name, types[name], v) for v in args[1:]])
    if op in ("like", "ilike"):
        return _like(op, args, types)
    raise InvalidFilter(f"unknown operator {op!r}")


def _arity(op: str, args: list, n: int) -> None:
    if len(args) != n:
        raise InvalidFilter(f"{op} takes {n} operand(s)")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _resolve(name: Any, types: dict[str, T.DataType]) -> str:
    """The real column behind a name: exact match first, then ignoring case."""
    if isinstance(name, str):
        if name in types:
            return name
        same = [c for c in types if c.lower() == name.lower()]
        if len(same) == 1:
            return same[0]
    raise InvalidFilter(f"unknown column {name!r}")


def _text(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def _literal(name: str, dtype: T.DataType, value: Any) -> Column:
    if isinstance(dtype, T.StructType):
        raise InvalidFilter(f"{name} can only be tested for null")
    if value is None or not isinstance(value, (str, int, float, bool, Decimal, dt.date, dt.datetime)):
        raise InvalidFilter(f"{value!r} is not a literal")
    bucket = type_bucket(dtype)
    if bucket == "string":
        return F.lit(_text(value))
    if bucket == "numeric":
        return _number(name, dtype, value)
    if bucket == "boolean":
        text = _text(value).lower()
        if text in ("true", "1"):
            return F.lit(True)
        if text in ("false", "0"):
            return F.lit(False)
        raise InvalidFilter(f"{value!r} is not a boolean for {name}")
    if bucket == "datetime":
        return _moment(name, dtype, value)
    return F.lit(value)


def _number(name: str, dtype: T.DataType, value: Any) -> Column:
    if isinstance(value, bool) or (not isinstance(value, (int, float, Decimal)) and not NUMBER.fullmatch(str(value))):
        raise InvalidFilter(f"{value!r} is not a number for {name}")
    exact = Decimal(str(value))
    if not exact.is_finite():
        raise InvalidFilter(f"{value!r} is not a number for {name}")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.lit(float(exact))
    if exact == exact.to_integral_value() and abs(exact) < 2**63:
        return F.lit(int(exact))
    return F.lit(exact)


def _moment(name: str, dtype: T.DataType, value: Any) -> Column:
    if isinstance(value, (int, float, bool, Decimal)):
        raise InvalidFilter(f"{value!r} is not a date or time for {name}")
    text = value.isoformat(" ") if isinstance(value, dt.datetime) else str(value)
    try:
        dt.datetime.fromisoformat(text)
    except ValueError as e:
        raise InvalidFilter(f"{value!r} is not a date or time for {name}") from e
    return F.lit(text).cast(dtype)


def _like(op: str, args: list, types: dict[str, T.DataType]) -> Column:
    if len(args) not in (2, 3):
        raise InvalidFilter(f"{op} takes a column, a pattern and an optional escape character")
    name = _resolve(args[0], types)
    if type_bucket(types[name]) != "string":
        raise InvalidFilter(f"{op} needs a text column, {name} is not")
    pattern = _text(args[1])
    escape = args[2] if len(args) == 3 else "\\"
    if not isinstance(escape, str) or len(escape) != 1:
        raise InvalidFilter("escape must be a single character")
    at = 0
    while at < len(pattern):
        if pattern[at] == escape:
            if at + 1 == len(pattern) or pattern[at + 1] not in ("%", "_", escape):
                raise InvalidFilter(f"bad escape in pattern {pattern!r}")
            at += 1
        at += 1
    match = F.like if op == "like" else F.ilike
    return match(F.col(_quoted(name)), F.lit(pattern), F.lit(escape))
