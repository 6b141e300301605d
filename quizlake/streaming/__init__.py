"""Structured Streaming forms of the frame filter and of progress events."""
