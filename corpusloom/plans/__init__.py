"""Pipelines of stages and the panels computed over their results."""
