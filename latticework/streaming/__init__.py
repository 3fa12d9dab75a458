"""Structured Streaming message channel."""
