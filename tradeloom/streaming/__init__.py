"""Streaming of the trade-network engine."""
