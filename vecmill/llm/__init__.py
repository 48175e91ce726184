"""Operators of a training-data pipeline.

Nothing outside this subpackage (and the two top-level registries) imports it.
"""
