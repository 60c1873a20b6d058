"""Incremental and stateful forms."""
