"""All queries of the reference's operator families, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from plumbline.plans import census, custom, judged, linkage, ordered, relational, scans, statements, whole

MODULES = (census, relational, custom, linkage, judged, statements, scans, ordered, whole)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
