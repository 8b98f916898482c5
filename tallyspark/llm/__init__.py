"""Operators of a training-data pipeline over ``documents``-like tables.

Nothing outside this folder imports it; ``queries.py`` registers one query per
operator and ``corpus_pipeline.py`` (repository top) chains five of them.
"""
