"""Readers, flattening, file checks and sinks."""
