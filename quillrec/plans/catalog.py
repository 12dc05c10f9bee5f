"""All registered queries."""

from quillrec.plans import views  # noqa: F401  (named check SQL comes first)
from quillrec.plans import base_queries, rank_queries, recall_queries, serving_queries  # noqa: F401
from quillrec.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
