"""Registry of the engine's own queries and their oracle SQL."""

from __future__ import annotations

from .core_queries import QUERIES, hybrid_search
from .oracles import ORACLES


def flagship(spark, sf_dir):
    return hybrid_search(spark, sf_dir)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return dict(ORACLES)
