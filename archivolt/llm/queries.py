"""Queries of this subpackage and their SQL by name."""

from __future__ import annotations

from archivolt.llm import p2, p3, p4, p5, p6, p7, p8, p9, p10

MODULES = (p2, p3, p4, p5, p6, p7, p8, p9, p10)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
