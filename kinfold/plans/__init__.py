"""The library's own queries."""

from kinfold.plans import dedup, items, pictures, vectors  # noqa: F401
from kinfold.plans.registry import QUERIES, SQL  # noqa: F401
