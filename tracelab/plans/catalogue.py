"""All registered queries."""

from __future__ import annotations

from tracelab.plans import result_queries, sample_queries, source_queries, trace_queries, visit_queries  # noqa: F401
from tracelab.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    return QUERIES["m1_labelled_samples"](spark, sf_dir)
