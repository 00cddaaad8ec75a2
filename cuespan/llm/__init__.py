"""Operators for preparing language-model training text; nothing else in the library imports this."""
