"""Structured Streaming extensions; the batch operators remain the definition of their results."""
