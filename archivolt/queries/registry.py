"""All core queries and their SQL by name."""

from __future__ import annotations

from archivolt.queries import extra, index, more, p1, pipeline, search, text

MODULES = (p1, text, index, search, pipeline, more, extra)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
