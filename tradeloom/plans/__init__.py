"""Plans of the trade-network engine."""
