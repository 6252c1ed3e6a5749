"""Registered queries; importing the modules fills the registry."""

from . import analytics, delivery, enrichment, language, market, profiles, replay, retrieval
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analytics", "delivery", "enrichment", "language", "market", "profiles", "replay", "retrieval"]
