"""All queries of this subpackage, and the SQL that says the same."""

from __future__ import annotations

from . import decontaminate, html_text, language, mixing, near_dup, quality, secrets, sharding, tokens, urls

_MODULES = (decontaminate, mixing, secrets, quality, sharding, near_dup, urls, tokens, html_text, language)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
