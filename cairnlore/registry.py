"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from cairnlore.plans import activity, answers, composite, graph, knowledge, text

PLANS = (activity, text, graph, knowledge, composite, answers)


def queries() -> dict:
    return {k: f for p in PLANS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for p in PLANS for k, q in p.SQL.items()}
