"""Kept tables that follow a stream of events."""
