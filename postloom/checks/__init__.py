"""Registered queries and the SQL each one is checked against."""

import importlib

from postloom.checks.registry import ORACLES, QUERIES

TOPICS = ["feed", "text", "vectors", "clusters", "streams"]


def load():
    """All queries and all SQL checks by name."""
    for topic in TOPICS:
        importlib.import_module(f"postloom.checks.{topic}")
    return QUERIES, ORACLES
