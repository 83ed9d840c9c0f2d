"""Readers, page parsing and sinks."""
