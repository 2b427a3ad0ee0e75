"""Spark-native analytics over log-structured key-value data."""

from kvloom.config import Options
from kvloom.errors import Closed, EmptyKey, HandlerTimeout, KeyNotFound, NoHandler, PublishRefused, StoreError
from kvloom.sources.store import KVStore, open_store

__all__ = ["Closed", "EmptyKey", "HandlerTimeout", "KVStore", "KeyNotFound", "NoHandler", "Options", "PublishRefused", "StoreError", "open_store"]
