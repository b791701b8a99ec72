"""All registered queries with their oracle SQL."""

from catalog import base, text, vectors, models, reports  # noqa: F401
from catalog.base import ORACLES, QUERIES  # noqa: F401
