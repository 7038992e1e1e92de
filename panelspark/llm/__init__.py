"""Operators for training-data pipelines over a table of documents.

Nothing outside this folder and corpus_pipeline.py imports it. Modules with `queries.py` names register one query each.
"""
