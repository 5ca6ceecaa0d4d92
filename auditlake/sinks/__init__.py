"""Sinks: result JSON, pattern dictionary, run metrics, rejected lines, parsed table."""
