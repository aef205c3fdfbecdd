"""Composite scorer, diagnostics and the collection scan."""
