"""All registered queries."""

from tritmarts.plans import catalog_cards, catalog_marts, catalog_ranking, catalog_scenarios  # noqa: F401
from tritmarts.plans.registry import ORACLES, QUERIES  # noqa: F401
