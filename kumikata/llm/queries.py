"""All queries of this subpackage, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from kumikata.llm import p01, p02, p03, p04, p05, p06, p07, p08, p09, p10

_MODULES = (p01, p02, p03, p04, p05, p06, p07, p08, p09, p10)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
