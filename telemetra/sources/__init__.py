"""Readers: payloads, stored points, labelled lines, and the test-table adapters."""
