"""Functions of the rules engine."""
