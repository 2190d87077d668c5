"""Pipelines: their specification, and how their tasks run."""
