"""Registered queries. Importing a module registers what it holds."""

from frameledger.plans import comparison, curation, imaging, masking, quality, streams, training  # noqa: F401
from frameledger.plans.registry import CHECKS, COVERS, QUERIES

__all__ = ["CHECKS", "COVERS", "QUERIES"]
