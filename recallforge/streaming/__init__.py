"""Structured Streaming: log ingestion, last-write-wins views, windowed aggregates."""
