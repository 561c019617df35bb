"""Sketch aggregates and join-size bounds."""
