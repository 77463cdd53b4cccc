"""Inputs: message topics, recorded replays, Parquet tables."""
