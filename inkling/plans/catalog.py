"""All queries of this package, by name."""

from . import decision_queries, estimate_queries, join_queries, online_queries, pipeline_queries, report_queries, source_queries  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
