"""Operators for preparing language-model training data at scale.

Every operator here takes and returns DataFrames.  Nothing outside this
subpackage imports it, so it can be removed without touching the rest.
"""
