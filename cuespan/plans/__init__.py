"""Queries of the operators; importing them registers them."""

from . import queries, more  # noqa: F401, I001
