"""Structured Streaming over arriving claims."""
