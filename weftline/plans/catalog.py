"""Every registered query, and its SQL where there is any."""

from __future__ import annotations

from . import corpus, gen1, oracle, queries, scoring, selections, training

QUERIES = queries.QUERIES
SQL: dict[str, str] = dict(oracle.SQL)
for module in (corpus, scoring, training, selections, gen1):
    SQL |= {name: body if name in getattr(module, "PLAIN", ()) else oracle.with_prelude(body) for name, body in module.SQL.items()}
