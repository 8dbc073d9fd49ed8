"""Streaming forms of the keyed, time-driven jobs."""
