"""All queries of the library outside of llm, by name, and their SQL."""

from __future__ import annotations

from leafmill.plans import answers, documents, engine, files, metrics, questions, search, streams, tables

_ALL = (search.CATALOG, documents.CATALOG, tables.CATALOG, questions.CATALOG, metrics.CATALOG, streams.CATALOG, engine.CATALOG, answers.CATALOG, files.CATALOG)
QUERIES = {name: query for c in _ALL for name, query in c.queries.items()}
ORACLE_SQL = {name: sql for c in _ALL for name, sql in c.sql.items()}
COVERS = {name: rows for c in _ALL for name, rows in c.covers.items()}
