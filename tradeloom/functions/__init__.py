"""Functions of the trade-network engine."""
