"""Registered queries over the test tables and their SQL counterparts."""

from hearthgrid.catalog import decisions, modelling, preparation, tables  # noqa: F401
from hearthgrid.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
