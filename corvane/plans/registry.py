"""All queries of the library proper, and the SQL that says the same."""

from __future__ import annotations

from ..operators import dataset, evaluate, recovery, runs
from . import functions

_MODULES = (evaluate, dataset, recovery, runs, functions)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
