"""Foreclosure-auction operators built from the general ones."""
