"""Queries over the tables of a folder, one module a family of operators."""

from . import cascades, extraction, findings, judicial, people, records, search, texts  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
