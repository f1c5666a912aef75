"""Operators that prepare text and vectors for training language models.

Each module holds one operator; ``queries`` applies them to the whole generated tables.
Nothing else in the library imports this subpackage.
"""
