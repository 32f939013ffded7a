"""Pipelines of stages."""
