"""Registered queries over the provided tables, one module per family of operators."""

from loomgraph.plans import graphs, relational, resolution, scalars, texts, views  # noqa: F401  (each registers its queries)
from loomgraph.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
