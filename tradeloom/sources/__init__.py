"""Sources of the trade-network engine."""
