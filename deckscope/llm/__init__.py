"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``benchmark``.

Nothing outside this subpackage (but ``corpus_pipeline.py``) imports it.
"""
