"""Structured Streaming audits."""
