"""Operators for preparing language-model training data.

Every operator takes DataFrames and returns DataFrames.  Nothing outside this
subpackage imports it; ``queries`` registers its queries with the entry module.
"""
