"""Names, columns and checks that several text operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not use yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    Texts of ASCII characters alone take the quicker ``lower``.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def bucket_of(key: Column, buckets: int) -> Column:
    """crc32 of the key as decimal text, modulo ``buckets``; null keys give null."""
    return (F.crc32(key.cast("string").cast("binary")) % buckets).cast("int")


# What operators keep in a Python worker from one task to the next, and how to drop it.
_KEPT: dict[str, Callable[[], object]] = {}
_TURN = [""]


def keeps(owner: str, drop: Callable[[], object]) -> None:
    """Name what ``owner`` keeps in a worker, by the function that drops it."""
    _KEPT[owner] = drop


def take_turn(owner: str) -> None:
    """A task of ``owner`` begins: workers are reused, so what others kept is dropped.

    Tasks of the same kind in a row find what they kept. Free memory goes back to
    the system, where the C library offers it.
    """
    if _TURN[0] == owner:
        return
    _TURN[0] = owner
    for name, drop in _KEPT.items():
        if name != owner:
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
