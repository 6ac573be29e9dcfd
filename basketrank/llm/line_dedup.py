"""Repeated lines across documents, found with two Bloom filters.

A line's key is the line without blanks at its ends, A-Z in lower case. Keys of
at least ``min_chars`` code points that occur in at least ``min_docs`` documents
lose all their lines except those of the document with the largest id.

1. Every task fills two Bloom filters with the hashes of its keys, one bit set
   for keys seen once and one for keys seen again (each row counts a key once).
   Bits that two tasks saw once are seen twice as well. The filters travel in
   segments, sparse ones as positions, and are merged segment by segment.
2. Only keys whose bits are all in the twice-seen filter are suspects. They are
   staged as (key digest, id) and counted exactly; all other lines stay put.
3. The digests that a document loses are joined to it and its lines cut.

The twice-seen filter is the only thing broadcast. Its bits follow the number
of rows between ``MIN_BITS`` and ``MAX_BITS`` (128 MB); beyond that more keys are
suspected by mistake, and the exact counts discard them.

Defined results: a null or empty text is one empty line; null ids do not count as
documents, so rows with a null id lose every line that is dropped elsewhere; rows
that share an id are one document; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from basketrank.functions.joins import lookup
from basketrank.functions.staging import stage
from basketrank.llm.common import fresh, named

MIN_CHARS = 40
MIN_DOCS = 5
BITS_PER_ROW = 256
MIN_BITS, MAX_BITS = 1 << 20, 1 << 30
#: Bits set for each key.
PROBES = 3
_SEGMENT_BITS = 1 << 16
_BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line, or None when it is too short to be looked at."""
    key = line.strip(_BLANKS)
    return key.encode().lower() if len(key) >= min_chars else None


def text_keys(text: str | None, min_chars: int = MIN_CHARS) -> set[bytes]:
    if not text or len(text) < min_chars:
        return set()
    return {k for line in text.split("\n") if (k := line_key(line, min_chars))}


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(PROBES, n) bit positions; two halves of a hash give all of them."""
    low = hashes & np.uint64(0xFFFFFFFF)
    high = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(low + np.uint64(k) * high) % np.uint64(bits) for k in range(PROBES)]).astype(np.int64)


class Bloom:
    """Bits of a filter, packed into bytes."""

    def __init__(self, bits: int, packed: np.ndarray | None = None):
        self.bits = bits
        self.packed = np.zeros(bits // 8, np.uint8) if packed is None else packed

    def add(self, where: np.ndarray) -> None:
        np.bitwise_or.at(self.packed, where.ravel() >> 3, np.uint8(1) << (where.ravel() & 7).astype(np.uint8))

    def holds(self, where: np.ndarray) -> np.ndarray:
        return ((self.packed[where >> 3] >> (where & 7).astype(np.uint8)) & 1).all(axis=0)


def pack(part: np.ndarray) -> bytes:
    """A segment as its set positions when they are few, else as it is."""
    if np.bitwise_count(part).sum(dtype=np.int64) < _SEGMENT_BITS // 16:
        return np.flatnonzero(np.unpackbits(part, bitorder="little")).astype(np.uint16).tobytes()
    return part.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if len(data) == _SEGMENT_BITS // 8:
        return np.frombuffer(data, np.uint8)
    out = np.zeros(_SEGMENT_BITS, np.uint8)
    out[np.frombuffer(data, np.uint16)] = 1
    return np.packbits(out, bitorder="little")


def filter_bits(rows: int) -> int:
    wanted = max(1, rows) * BITS_PER_ROW
    return min(MAX_BITS, max(MIN_BITS, 1 << (wanted - 1).bit_length()))


def twice_seen(texts: DataFrame, bits: int, min_chars: int = MIN_CHARS) -> Bloom:
    """The twice-seen filter of the keys in the one text column of ``texts``."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(bits), Bloom(bits)
        for batch in batches:
            hashes: list[int] = []
            for text in batch.column(0):
                hashes += [xxhash.xxh3_64_intdigest(k) for k in text_keys(text.as_py(), min_chars)]
            seen, counts = np.unique(np.array(hashes, np.uint64), return_counts=True)
            where = places(seen, bits)
            twice.add(where[:, (counts > 1) | once.holds(where)])
            once.add(where)
        step = _SEGMENT_BITS // 8
        used = np.flatnonzero(once.packed.reshape(-1, step).any(axis=1))
        for some in np.array_split(used, len(used) // 256 + 1):
            parts = [(int(i), slice(i * step, (i + 1) * step)) for i in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in parts], pa.int32()),
                    pa.array([pack(once.packed[s]) for _, s in parts], pa.binary()),
                    pa.array([pack(twice.packed[s]) for _, s in parts], pa.binary()),
                ],
                ["segment", "once", "twice"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([pack(twice)], pa.binary())], ["segment", "twice"]
            )

        for batch in batches:
            for segment, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if segment != at:
                    if at is not None and twice.any():
                        yield done()
                    at, once, twice = segment, unpack(a).copy(), unpack(b).copy()
                else:
                    a = unpack(a)
                    twice |= unpack(b) | (once & a)
                    once |= a
        if at is not None and twice.any():
            yield done()

    found = (
        texts.mapInArrow(fill, "segment int, once binary, twice binary")
        .repartition("segment")
        .sortWithinPartitions("segment")
        .mapInArrow(merge, "segment int, twice binary")
    )
    packed = np.zeros(bits // 8, np.uint8)
    step = _SEGMENT_BITS // 8
    for row in found.toLocalIterator():
        packed[row.segment * step : (row.segment + 1) * step] = unpack(bytes(row.twice))
    return Bloom(bits, packed)


def suspects(rows: DataFrame, filter_: Bloom, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, _id, _print) of keys that the filter has; ``rows`` is (_id, _print, _text)."""
    shared = rows.sparkSession.sparkContext.broadcast(filter_.packed)
    bits = filter_.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bloom(bits, shared.value)
        for batch in batches:
            keys, owner = [], []
            for i, text in enumerate(batch.column(2)):
                found = text_keys(text.as_py(), min_chars)
                keys += found
                owner += [i] * len(found)
            hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
            kept = np.flatnonzero(known.holds(places(hashes, bits)))
            own = pa.array(np.array(owner, np.int64)[kept])
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(keys[i]) for i in kept], pa.binary()), batch.column(0).take(own), batch.column(1).take(own)],
                ["key", "_id", "_print"],
            )

    kind = T.StructType([T.StructField("key", T.BinaryType()), rows.schema["_id"], rows.schema["_print"]])
    return rows.mapInArrow(run, kind)


def lost_keys(
    docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(_id, _print, keys): digests of the keys whose lines a row loses."""
    rows = docs.select(
        named(id_col).alias("_id"), F.xxhash64(named(text_col)).alias("_print"), named(text_col).alias("_text")
    )
    bits = filter_bits(docs.count())
    found = stage(suspects(rows, twice_seen(rows.select("_text"), bits, min_chars), min_chars), "repeated-lines")
    often = (
        found.select("key", "_id")
        .distinct()
        .groupBy("key")
        .agg(F.count("_id").alias("n"), F.max("_id").alias("best"))
        .filter(F.col("n") >= min_docs)
        .select("key", "best")
    )
    # A key of very many rows is joined map-side or split, and leaves no rows together.
    return (
        lookup(found, stage(often, "often"), "key", "inner", row_bytes=96, spread="_print")
        .filter(~F.col("_id").eqNullSafe(F.col("best")))
        .groupBy("_id", "_print")
        .agg(F.collect_set("key").alias("keys"))
    )


def drop_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    lines_name: str = "n_lines",
    dropped_name: str = "n_dropped",
) -> DataFrame:
    """``docs`` with the repeated lines cut from the text, and two counts of lines.

    The new names must not be among the columns of ``docs``.
    """
    own, own_print, keys = fresh(docs, "_id", "_print", "keys")
    lost = lost_keys(docs, id_col, text_col, min_chars, min_docs).toDF(own, own_print, keys)
    same = named(id_col).eqNullSafe(named(own)) & (F.xxhash64(named(text_col)) == named(own_print))
    joined = docs.join(lost.hint("shuffle_hash"), same, "left").select(*map(named, docs.columns), keys)
    at = docs.columns.index(text_col)
    fields = [*docs.schema]
    fields[at] = T.StructField(text_col, T.StringType())
    kind = T.StructType([*fields, T.StructField(lines_name, T.LongType()), T.StructField(dropped_name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, gone in zip(batch.column(at), batch.column(len(fields))):
                text = text.as_py() or ""
                parts, gone = text.split("\n"), gone.as_py()
                left = parts
                if gone:
                    gone = set(gone)
                    left = [p for p in parts if (k := line_key(p, min_chars)) is None or digest(k) not in gone]
                    text = "\n".join(left)
                texts.append(text)
                lines.append(len(parts))
                dropped.append(len(parts) - len(left))
            columns = list(batch.columns[: len(fields)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                [*batch.schema.names[: len(fields)], lines_name, dropped_name],
            )

    return joined.mapInArrow(run, kind)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256): counts and the hash of the text that stays."""
    narrow = docs.select(named(id_col).alias("_id"), named(text_col).cast("string").alias("_text"))
    return drop_lines(narrow, "_id", "_text").select(
        F.col("_id").alias(id_col),
        "n_lines",
        "n_dropped",
        F.sha2(F.col("_text").cast("binary"), 256).alias("kept_sha256"),
    )
