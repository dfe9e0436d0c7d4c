"""Structured Streaming twins of the service's operators."""
