"""Queries of the library bound to the generated test tables, each with its SQL twin."""
