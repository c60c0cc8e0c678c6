"""Streaming of the rules engine."""
