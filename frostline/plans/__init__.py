"""The study's relations, the registered queries and their SQL."""

from . import extras, oracle
from .queries import QUERIES

SQL = oracle.SQL | extras.SQL

__all__ = ["QUERIES", "SQL"]
