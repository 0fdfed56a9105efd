"""Compositions of operators: feature frames, back-tests, models."""
