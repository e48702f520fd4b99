"""All queries over the driver's tables, by name."""

from tidemark.plans import base_queries, module_queries, more_queries, risk_queries, signal_queries, stream_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

FLAGSHIP = "risk_timeline"
