"""Importing the package registers every query."""

from gaugeworks.entries import bronze, checks, gold, graph, search, serve, sketch, versioned  # noqa: F401
from gaugeworks.entries.registry import ORACLES, QUERIES  # noqa: F401
