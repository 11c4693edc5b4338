"""All registered queries of the engine (text queries are in varspark.llm)."""

from __future__ import annotations

from . import queries_fast, queries_full, queries_more

QUERIES = {**queries_fast.QUERIES, **queries_full.QUERIES, **queries_more.QUERIES}
ORACLE = {**queries_fast.ORACLE, **queries_full.ORACLE, **queries_more.ORACLE}
