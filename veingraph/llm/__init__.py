"""Operators that prepare text corpora for language-model training.

Nothing else in :mod:`veingraph` imports this subpackage.
"""
