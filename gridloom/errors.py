"""Errors of the engine."""

from __future__ import annotations


class LookupFailed(KeyError, RuntimeError):
    """No entry, more than one entry, or a second entry of one name in a registry; its text is the plain message."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class InvalidKey(ValueError):
    """A name that can't be part of a storage path."""
