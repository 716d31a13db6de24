"""Imports every catalog module so that its queries are registered."""

from . import activity, chaining, cleaning, evidence, judging, spikes, streams, wording  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
