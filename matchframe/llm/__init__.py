"""Operators of a training-data pipeline; nothing else in the library imports this package."""

from .base import ORACLES, QUERIES
from . import bpe_codec, chat_format, decontamination, fingerprints, html_extract, minhash_tensor, quality_lm, secret_scan, simhash_gray, spelling, token_counts, toxicity, turn_repair  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
