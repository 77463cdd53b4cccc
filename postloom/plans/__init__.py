"""Whole jobs: reports, live analytics, collection, embedding, cluster map."""
