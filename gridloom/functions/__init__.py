"""Hashes, wide integers, number theory."""
