"""Registered queries: all modules of this package put theirs in the registry of ``queries``."""

from . import queries, whole_frames  # noqa: F401
