"""Corpus preparation for language-model training. Nothing outside this package imports it."""
