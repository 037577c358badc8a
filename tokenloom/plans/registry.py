"""Named queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from tokenloom.plans.oracles import oracles
from tokenloom.plans.queries import QUERIES

__all__ = ["QUERIES", "oracles"]
