"""Operators of a training-data pipeline over tables of documents.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries.py`` derives the registered
queries from them.
"""
