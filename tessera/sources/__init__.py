"""Readers with rejection accounting, and sinks."""
