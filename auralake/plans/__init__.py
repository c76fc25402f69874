"""Named queries over the test tables, each with the SQL that must give the same rows."""

from auralake.plans import matching, relations, signals, streams, texts
from auralake.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "matching", "relations", "signals", "streams", "texts"]
