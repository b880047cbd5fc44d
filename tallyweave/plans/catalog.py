"""All registered queries of the core: importing this module fills the registry."""

from __future__ import annotations

from tallyweave.plans import analytics, ingest, names, quality, retrieval  # noqa: F401
from tallyweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
