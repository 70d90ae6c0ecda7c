"""Relational and learning operators."""
