"""All queries of the library with their SQL; each group of operators has a module of its own."""

from __future__ import annotations


def _modules() -> list:
    from verdata.plans import curation_queries, evaluation_queries, rollout_queries, streaming_queries

    return [curation_queries, evaluation_queries, rollout_queries, streaming_queries]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLE.items()}


def flagship(spark, sf_dir):
    return queries()["entry_profile"](spark, sf_dir)
