"""Parsing inputs that arrive in chunks."""
