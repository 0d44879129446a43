"""Incremental runs on streams."""
