"""Named queries over the driver's tables, one or more per operator, each with its SQL twin."""

from __future__ import annotations


def all_queries():
    """The registered queries and their SQL."""
    from tessella.plans import (  # noqa: F401
        diagnostics, distributions, estimators, features, pools, recipes, relational, scoring, selection, sources,
    )
    from tessella.plans.registry import ORACLE, QUERIES

    return QUERIES, ORACLE


def flagship(spark, sf: str):
    from tessella.plans.scoring import report_by_type  # noqa: PLC0415

    return report_by_type(spark, sf)
