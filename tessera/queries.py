"""Registered queries and their SQL, gathered from the query modules."""

from .plans import classify, corpus, evidence, events, metrics, more, timetable, urls  # noqa: F401
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
