"""Structured Streaming front ends over the batch operators."""
