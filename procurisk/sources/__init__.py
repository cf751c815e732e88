"""Schemas, readers, role views and sinks."""
