"""Micro-batch classification and event-time windows."""
