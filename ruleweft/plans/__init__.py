"""Plans of the rules engine."""
