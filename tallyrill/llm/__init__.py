"""Operators that prepare text corpora for language-model training.

Nothing else in the package imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` holds the thin ``opN_`` queries.
"""
