"""All registered queries."""

from korbwerk.plans import core, extraction, favourites, further, layouts, manifests, more, pages, persisted, quality, savings, scalar, strict, titles, wording  # noqa: F401
from korbwerk.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
