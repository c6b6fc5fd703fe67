"""Whole pipelines, and the bindings of every operator to the given tables."""
