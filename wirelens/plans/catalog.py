"""All registered queries and their SQL, collected from the catalogue modules."""

from wirelens.plans import catalog_flows, catalog_models, catalog_scores, catalog_states  # noqa: F401
from wirelens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
