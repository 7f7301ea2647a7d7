"""Operators of the trade-network engine."""
