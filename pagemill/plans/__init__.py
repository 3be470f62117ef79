"""All named queries; importing this package fills the registry."""

from pagemill.plans.registry import ORACLES, QUERIES
from pagemill.plans import activity, html, io, knowledge, labels, merge, quality, reports, search, text, trends, urls, workflows  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
