"""Retail price analytics expressed as Spark DataFrame jobs."""

from shelfwise.config import Settings
from shelfwise.session import configure

__all__ = ["Settings", "configure"]
