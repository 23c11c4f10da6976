"""The engine's registered queries and their SQL counterparts."""

from __future__ import annotations

from corpusloom.queries import more, relational, texts

_TABLE = relational.TABLE | texts.TABLE | more.TABLE
QUERIES = {name: query for name, (query, _) in _TABLE.items()}
ORACLES = {name: sql for name, (_, sql) in _TABLE.items() if sql}
