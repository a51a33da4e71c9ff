"""Registered queries over the shared tables, and the SQL that gives the same rows."""

from gleanery.plans import (  # noqa: F401  registers
    acquisition_queries,
    corpus_queries,
    detail_queries,
    evidence_queries,
    file_queries,
    function_queries,
    further_queries,
    gate_queries,
    learning_queries,
    more_queries,
    page_queries,
    rule_queries,
    score_queries,
    streaming_queries,
)
from gleanery.plans.registry import QUERIES, SQL


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict:
    return dict(SQL)
