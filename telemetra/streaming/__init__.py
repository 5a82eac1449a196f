"""Structured Streaming versions of ingest and the live views."""
