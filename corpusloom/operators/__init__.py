"""Stages and table operators."""
