"""Registered queries: ``catalog``, and ``more`` which adds to it."""

from . import catalog, more  # noqa: F401
