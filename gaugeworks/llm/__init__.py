"""Operators for preparing text corpora, and the numbered queries that apply them."""

from gaugeworks.llm.queries import ORACLES, QUERIES  # noqa: F401
