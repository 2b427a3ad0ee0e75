"""Store options.

Setters return a changed copy. As in the engine this one replaces, a value out of range leaves the option as it was.
Options that only tune a single-file writer (queue, buffers, pre-allocation) are accepted and kept, and have no effect here.
Compression works on pages of values, so its threshold has a meaning only in the single-file layout (rawlog).
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace
from typing import Any


@dataclass(frozen=True)
class Options:
    shards: int = 64
    queue_capacity: int = 10_000
    cache_size: int = 10_000
    pool_size: int = 10
    bloom_items: int = 1_000_000
    bloom_fpr: float = 0.01
    batch_min: int = 10
    batch_max: int = 1000
    batch_delay_s: float = 0.05
    compression: bool = False
    compression_threshold: int = 4096
    compression_level: int = 0
    compaction_min_items: int = 1000
    compaction_threshold: float = 0.3
    compaction_interval_s: float = 1800.0
    initial_size: int = 20 << 20
    writer_buffer: int = 4 << 20
    flush_timeout_s: float = 10.0
    cardinality: bool = True
    precision: int = 14
    frequency: bool = True
    cms_eps: float = 0.01
    cms_depth: int = 7
    wal: bool = False
    wal_async: bool = False
    wal_interval_s: float = 0.1
    wal_buffer: int = 4 << 20
    maintenance: bool = True
    report_interval_s: float = 60.0
    call_timeout_s: float = 5.0
    logger: logging.Logger = field(default_factory=lambda: logging.getLogger("kvloom"))
    executor: Any = None
    health: Any = None
    scheduler: Any = None

    def _if(self, ok: bool, **changes: Any) -> Options:
        return replace(self, **changes) if ok else self

    def with_shards(self, n: int) -> Options:
        return self._if(n > 0, shards=n)

    def with_queue_capacity(self, n: int) -> Options:
        return self._if(n > 0, queue_capacity=n)

    def with_cache_size(self, n: int) -> Options:
        return self._if(n > 0, cache_size=n)

    def with_pool_size(self, n: int) -> Options:
        return self._if(n > 0, pool_size=n)

    def with_bloom(self, items: int, fpr: float) -> Options:
        return self._if(items > 0, bloom_items=items)._if(0 < fpr < 1, bloom_fpr=fpr)

    def with_batch(self, least: int, most: int, delay_s: float) -> Options:
        return self._if(least > 0, batch_min=least)._if(most > 0, batch_max=most)._if(delay_s > 0, batch_delay_s=delay_s)

    def with_compression(self, on: bool, threshold: int, level: int) -> Options:
        return replace(self, compression=on)._if(threshold > 0, compression_threshold=threshold)._if(0 <= level <= 9, compression_level=level)

    def with_compaction(self, min_items: int, threshold: float, interval_s: float) -> Options:
        return self._if(min_items > 0, compaction_min_items=min_items)._if(0 < threshold < 1, compaction_threshold=threshold)._if(interval_s > 0, compaction_interval_s=interval_s)

    def with_initial_size(self, n: int) -> Options:
        return self._if(n > 0, initial_size=n)

    def with_writer_buffer(self, n: int) -> Options:
        return self._if(n > 0, writer_buffer=n)

    def with_flush_timeout(self, seconds: float) -> Options:
        return self._if(seconds > 0, flush_timeout_s=seconds)

    def with_cardinality(self, on: bool, precision: int) -> Options:
        return replace(self, cardinality=on)._if(10 <= precision <= 16, precision=precision)

    def with_frequency(self, on: bool) -> Options:
        return replace(self, frequency=on)

    def with_logger(self, logger: logging.Logger | None) -> Options:
        return self._if(logger is not None, logger=logger)

    def with_executor(self, executor: Any) -> Options:
        return replace(self, executor=executor)

    def with_health(self, health: Any) -> Options:
        return replace(self, health=health)

    def with_scheduler(self, scheduler: Any) -> Options:
        return replace(self, scheduler=scheduler)

    def with_wal_buffer(self, n: int) -> Options:
        return self._if(n > 0, wal_buffer=n)

    def with_wal_async(self, on: bool, interval_s: float = 0.1) -> Options:
        """Writes return before the write-ahead log has them; it is written every interval_s, and once it holds wal_buffer bytes."""
        return replace(self, wal_async=on)._if(interval_s > 0, wal_interval_s=interval_s)

    def with_maintenance(self, on: bool, report_interval_s: float = 60.0) -> Options:
        """Whether open() starts compaction checks and reports in the background."""
        return replace(self, maintenance=on)._if(report_interval_s > 0, report_interval_s=report_interval_s)

    def with_wal_disabled(self, off: bool) -> Options:
        return replace(self, wal=not off)
