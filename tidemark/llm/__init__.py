"""Operators for preparing language-model training data.

Each module holds one operator with its general interface; ``queries`` holds
the thin ``opN_`` queries over the standard tables.  Nothing outside this
subpackage imports it.
"""
