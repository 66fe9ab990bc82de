"""Structured Streaming: snapshots and events as they arrive."""
