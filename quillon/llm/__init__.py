"""Operators for preparing language-model training text.

``QUERIES`` and ``ORACLES`` are what ``__spark_entry__`` registers.  Nothing outside this
subpackage (and ``corpus_pipeline``) imports it.
"""
