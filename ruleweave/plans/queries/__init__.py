"""Every operator as a query over the driver tables, with its SQL twin where SQL can say it."""

from ruleweave.plans.queries.base import ORACLES, QUERIES
from ruleweave.plans.queries import (  # noqa: F401  (registration)
    contracts, documents, extraction, links, merges, polling, reads, resolution, scalars, stores,
)

__all__ = ["QUERIES", "ORACLES"]
