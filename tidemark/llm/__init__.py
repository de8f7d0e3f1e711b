"""Training-data operators: one module for each, plus ``queries`` with their thin queries and SQL.

Nothing outside this subpackage imports it except ``__spark_entry__.py`` (guarded) and ``corpus_pipeline.py``.
"""
