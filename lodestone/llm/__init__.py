"""Operators that prepare training text: rules, classifiers, dedup, mixing, sharding.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
