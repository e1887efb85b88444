"""Streaming forms of the change feed and the state machines."""
