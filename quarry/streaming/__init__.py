"""Incremental views over the change log, by Structured Streaming."""
