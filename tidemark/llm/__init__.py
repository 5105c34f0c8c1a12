"""Operators for corpora of language-model training text. Optional: nothing outside this subpackage imports it."""
