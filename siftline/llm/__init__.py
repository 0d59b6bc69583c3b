"""Corpus operators for training-data pipelines (dedup, classifiers, mixing, packing, filters).

Nothing outside this subpackage imports it.
"""
