"""Operators for training-data corpora: dedup, search, filters, tokenizers, packing, scoring.

Each module holds one operator with a general interface; ``queries`` binds them to the test tables.  Nothing else in
the library imports this package.  Operators read only the columns they name, so extra columns with any name are safe.
"""
