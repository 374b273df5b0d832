"""Training-data operators: ten pipeline components for large text corpora.

Nothing else in the library imports this subpackage.
"""
