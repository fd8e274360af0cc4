"""Operators of a training-data pipeline (token counts, near and exact
duplicates, archives, classifiers, nearest neighbours, packing, mixing).

Nothing outside this package imports it.  ``queries`` registers one query per
operator; the top-level ``corpus_pipeline`` module chains five of them.
"""
