"""Readers of tables and of supplier files."""
