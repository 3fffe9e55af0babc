"""All registered queries; importing the modules fills the registry."""

from .base import ORACLES, QUERIES
from . import history_queries, metric_queries, model_queries, scalar_queries, score_queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
