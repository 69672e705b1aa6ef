"""Readers of landed files and adapters of tables to the bar model."""
