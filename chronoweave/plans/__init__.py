"""Queries bound to the driver's tables and the scheduled jobs."""

from chronoweave.plans.registry import ORACLES, QUERIES
from chronoweave.plans import evidence, graph, market, stored, streams, validators  # noqa: F401  (they register their queries)
