"""Expressions and column functions."""
