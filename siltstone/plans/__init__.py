"""Queries over the synthetic test tables, and the SQL that checks them."""

from . import curation, detection, evaluation, lookups, sampling
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "curation", "detection", "evaluation", "lookups", "sampling"]
