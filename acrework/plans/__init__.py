"""Registered queries over the operators; importing this package registers them all."""

from acrework.plans import aggregates, domain, geometry, graph, joins, rules, scalars, sources, temporal, text, windows  # noqa: F401
from acrework.plans.registry import QUERIES, SQL  # noqa: F401
