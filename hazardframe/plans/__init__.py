"""Adapter views over the test tables, and the registered queries with their SQL."""

from . import details, documents, models, relations, scenarios, stores, texts, vectors  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
