"""Streaming views of the build event log."""
