"""Error classes of the engine."""

from __future__ import annotations


class CollectionError(Exception):
    """Anything the engine refuses to do."""


class InvalidArgument(CollectionError, ValueError):
    """A request that can never succeed as it is."""


class NotFound(CollectionError, KeyError):
    """No collection of that name."""


class AlreadyExists(CollectionError, FileExistsError):
    """A collection of that name is there."""


class FilterError(InvalidArgument):
    """A filter text that does not parse, or does not fit the attributes."""
