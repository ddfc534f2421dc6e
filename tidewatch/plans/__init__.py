"""Registered queries; importing the modules fills the registry."""

from tidewatch.plans import changes, gates, ingest, readmodels, scalar, search, streams  # noqa: F401
from tidewatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
