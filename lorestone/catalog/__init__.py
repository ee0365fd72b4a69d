"""Registered queries; importing the package loads all of them."""

from . import answer_queries, fact_queries, metric_queries, note_queries, search_queries, source_queries, stream_queries, text_queries, trace_queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "answer_queries", "fact_queries", "metric_queries", "note_queries", "search_queries", "source_queries", "stream_queries", "text_queries", "trace_queries"]
