"""Operators of a training-data pipeline; ``queries.py`` registers one query for each.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
