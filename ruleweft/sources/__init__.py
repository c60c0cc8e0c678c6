"""Sources of the rules engine."""
