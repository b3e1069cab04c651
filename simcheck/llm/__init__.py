"""Corpus preparation for language-model training: ten operators and their queries.

Nothing else in the package imports this folder.
"""
