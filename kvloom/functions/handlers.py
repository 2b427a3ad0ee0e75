"""Named request handlers: driver calls with a timeout, and the same functions as column UDFs."""

from __future__ import annotations

import threading
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kvloom.errors import HandlerTimeout, NoHandler


class Handlers:
    """The last registration of a name wins. An exception of a handler reaches the caller."""

    def __init__(self, timeout_s: float = 5.0) -> None:
        self.timeout_s = timeout_s or 5.0
        self._by_name: dict[str, Callable[[bytes], bytes]] = {}

    def register(self, name: str, fn: Callable[[bytes], bytes]) -> None:
        self._by_name[name] = fn

    def unregister(self, name: str) -> None:
        self._by_name.pop(name, None)

    def has(self, name: str) -> bool:
        return name in self._by_name

    def names(self) -> list[str]:
        return sorted(self._by_name)

    def call_direct(self, name: str, payload: bytes) -> bytes:
        fn = self._by_name.get(name)
        if fn is None:
            raise NoHandler(f'no handler registered for "{name}"')
        return fn(payload)

    def call(self, name: str, payload: bytes) -> bytes:
        if name not in self._by_name:
            raise NoHandler(f'no handler registered for "{name}"')
        answer: list = []

        def run() -> None:
            try:
                answer.append((True, self.call_direct(name, payload)))
            except BaseException as e:  # the caller gets it
                answer.append((False, e))

        worker = threading.Thread(target=run, daemon=True)
        worker.start()
        worker.join(self.timeout_s)
        if not answer:
            raise HandlerTimeout(f'call to "{name}" timed out')
        ok, value = answer[0]
        if not ok:
            raise value
        return value

    def column(self, name: str, payload: Column) -> Column:
        """The handler over a binary column, in Arrow batches; nulls stay null."""
        fn = self._by_name.get(name)
        if fn is None:
            raise NoHandler(f'no handler registered for "{name}"')
        return handler_udf(fn)(payload)


def handler_udf(fn: Callable[[bytes], bytes]):
    @F.pandas_udf("binary")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else fn(bytes(v)))

    return apply
