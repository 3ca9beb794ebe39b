"""Operators for large-scale training-data preparation.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
