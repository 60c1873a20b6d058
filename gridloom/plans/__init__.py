"""Registries of user functions and readiness reports."""
