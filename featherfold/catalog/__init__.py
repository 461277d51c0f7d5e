"""Registered queries: each is a Spark callable and, where SQL can say it, its ANSI twin."""

from .base import ORACLE, QUERIES
from . import (  # noqa: F401  (importing a module registers its queries)
    aggregation, cleaning, modelling, ordering, projection, scanning, screening,
)

__all__ = ["ORACLE", "QUERIES"]
