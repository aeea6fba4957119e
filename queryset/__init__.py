"""Registered queries over the driver tables, each with its SQL counterpart where SQL can say it."""

from queryset import catalog, features, filters, publish, tiles, traffic  # noqa: F401
from queryset.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
