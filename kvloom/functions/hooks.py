"""Interceptors as column expressions: a payload rewrite and a veto."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hooks:
    """on_publish, on_write and on_read rewrite a value column; veto and on_delete say which rows are refused."""

    on_publish: Callable[[Column], Column] | None = None
    veto: Callable[[Column], Column] | None = None
    on_write: Callable[[Column], Column] | None = None
    on_read: Callable[[Column], Column] | None = None
    on_delete: Callable[[Column], Column] | None = None


def published(publications: DataFrame, hooks: Hooks, payload: str = "payload") -> DataFrame:
    """Publications as subscribers get them. A veto that is null refuses nothing."""
    out = publications
    if hooks.veto:
        out = out.filter(~F.coalesce(hooks.veto(F.col(payload)), F.lit(False)))
    return out.withColumn(payload, hooks.on_publish(F.col(payload))) if hooks.on_publish else out


def written(log: DataFrame, hooks: Hooks) -> DataFrame:
    out = log.withColumn("value", F.when(F.col("op") == "put", hooks.on_write(F.col("value")))) if hooks.on_write else log
    return out.filter((F.col("op") != "del") | ~F.coalesce(hooks.on_delete(F.col("full_key")), F.lit(False))) if hooks.on_delete else out


def as_read(live: DataFrame, hooks: Hooks) -> DataFrame:
    return live.withColumn("value", hooks.on_read(F.col("value"))) if hooks.on_read else live
