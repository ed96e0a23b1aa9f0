"""Every operator as a query on the given tables, with its SQL twin where SQL can say it."""

from parlance.plans.catalog import archive, arcs, calendar, chains, people, words  # noqa: F401
from parlance.plans.catalog.registry import ORACLES, QUERIES  # noqa: F401
