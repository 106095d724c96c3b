"""Structured Streaming over the state tables."""
