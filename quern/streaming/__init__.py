"""Structured Streaming: incremental indexing and streams of queries."""
