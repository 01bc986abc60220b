"""Registered queries over the given tables."""

from docquarry.catalog import analysis, changes, ingest, lexical, search  # noqa: F401
from docquarry.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
