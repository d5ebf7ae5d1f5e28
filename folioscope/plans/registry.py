"""Every query of the library, and the SQL that must give the same rows."""

from __future__ import annotations

from . import geometry_queries, layout_queries, qr_queries, reader_queries, text_queries

_MODULES = (text_queries, layout_queries, geometry_queries, qr_queries, reader_queries)

QUERIES: dict = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
