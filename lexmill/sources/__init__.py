"""Formats: rules and writers of single values, and how DataFrames apply them."""
