"""Inputs and outputs: the retail tables, files, caches."""
