"""Structured Streaming forms of ingest, hourly buckets, sessions and latest-state upserts."""
