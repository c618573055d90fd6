"""Registered queries, each on whole tables, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioframe.plans import q_documents, q_fields, q_quality, q_sources

Query = Callable[[SparkSession, str], DataFrame]


def _all() -> dict[str, tuple[Query, str | None]]:
    return {**q_fields.QUERIES, **q_documents.QUERIES, **q_quality.QUERIES, **q_sources.QUERIES}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}
