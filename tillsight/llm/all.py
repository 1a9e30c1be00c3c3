"""Imports every module with queries, so the registry is complete."""

from tillsight.llm import backoff, fingerprint, html, langid, minhash, mixing, pieces, quality, resampling, sentences, simhash, suffixes, whitening  # noqa: F401
from tillsight.llm.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
