"""Compositions of the operators, and the registry of named queries with their SQL."""
