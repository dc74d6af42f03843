"""Keyed tables and texts that leave the engine."""
