"""Sinks, query sets, progress and replays for Structured Streaming."""
