"""Structured Streaming forms of the training-log analytics."""
