"""All registered queries."""

from trackloom.plans import metric_queries, route_queries, source_queries, window_queries  # noqa: F401
from trackloom.plans.registry import QUERIES  # noqa: F401
