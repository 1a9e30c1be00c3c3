"""Imports every catalogue module, so the registry is complete."""

from tillsight.catalogue import anonymity, exploring, recommending, tables  # noqa: F401
from tillsight.catalogue.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
