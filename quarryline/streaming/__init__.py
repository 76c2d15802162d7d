"""Incremental versions of the batch operators on Structured Streaming."""
