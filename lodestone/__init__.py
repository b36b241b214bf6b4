"""Lodestone: a PySpark engine for agent-memory analytics."""
