"""All registered queries."""

from stowfind.catalog import index, lookups, nested, retrieval, stream, text, upkeep  # noqa: F401
from stowfind.catalog.base import ORACLE, QUERIES  # noqa: F401
