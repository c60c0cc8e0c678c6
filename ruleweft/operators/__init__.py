"""Operators of the rules engine."""
