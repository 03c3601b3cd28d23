"""Readers, message parsers and sinks."""
