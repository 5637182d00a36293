"""Registered queries: the library's operators over the given tables, each with its SQL check."""

from .registry import checks, registered

__all__ = ["checks", "registered"]
