"""Every query of the library with its SQL."""

from __future__ import annotations

from stripcohort.jobs import blocks, cohort, comparisons, imaging, intake, kernels, statistics, training

MODULES = (cohort, comparisons, imaging, kernels, statistics, blocks, intake, training)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
