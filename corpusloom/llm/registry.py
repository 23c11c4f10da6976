"""Queries of this package, opN_<name>, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from corpusloom.llm import embeddings, html, licenses, minhash, mixing, packing, quality, sharding, toxicity, warc

MODULES = (embeddings, warc, quality, packing, minhash, sharding, html, mixing, licenses, toxicity)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
