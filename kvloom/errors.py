"""Errors raised by the store facade."""


class StoreError(Exception):
    """Base of all errors of this package."""


class Closed(StoreError):
    """The store was closed."""


class EmptyKey(StoreError, ValueError):
    """Keys must have at least one byte."""


class KeyNotFound(StoreError, KeyError):
    """The key has no live value."""


class NoHandler(StoreError, LookupError):
    """No handler has this name."""


class HandlerTimeout(StoreError, TimeoutError):
    """A handler did not answer in time."""


class PublishRefused(StoreError):
    """A publish hook refused the payload."""
