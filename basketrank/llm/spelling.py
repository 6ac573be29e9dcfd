"""Spelling variants: words one edit apart, grouped under their most frequent form.

1. Words are counted. Arrow tasks find the letter runs of whole texts on bytes and
   count them before anything is shuffled.
2. Near words share a half: with one error between them, either the left half of
   the first word is a prefix of the second or its right half is a suffix. Words of
   at least ``MIN_CHARS`` (7) code points are therefore dealt twice, by their first 3
   and by their last 4, into units of about ``UNIT_WORDS``.
3. Every unit builds a direction of a two-way FM index over its delimited words
   (:mod:`fm_index`) and matches one half of each of its words exactly, then the
   other with one error. A pair that both halves find counts for the left one.
4. A word's near words are counted and the best one chosen with partial results per
   unit. Forms lead to roots by pointer doubling: counts grow tenfold along a chain,
   so five rounds are enough for any 64-bit count.

A prefix or suffix of more than ``MOST_WORDS`` words is split: each of its units
indexes a part, and all its words ask every part, in batches. The asking rows are
then words x parts.

Defined results: null and empty texts have no words; a null id counts as an empty
one; repeated rows count again; an empty table gives no rows; ties go to the smaller
word in code-point order; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from basketrank.functions.joins import lookup
from basketrank.functions.staging import stage
from basketrank.llm.common import named
from basketrank.llm.fm_index import TwoWayIndex

MIN_CHARS = 7
MIN_COUNT = 2
DAMAGE = 31
TIMES = 10
UNIT_WORDS = 50_000
MOST_WORDS = 100_000
PREFIX, SUFFIX = MIN_CHARS // 2, MIN_CHARS - MIN_CHARS // 2
#: Bytes of text looked at in one go, and distinct words a task holds before it passes them on.
_PIECE = 1 << 22
_HELD = 400_000
#: Words that ask a unit's index at a time.
_ASKING = 50_000

# A letter is A-Z, a-z or U+00C0 to U+00FF, in UTF-8 the byte C3 and the one behind it.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table.astype(np.uint32)


_CRC = _crc_table()


def _crc32(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of many byte runs, each going on from the crc of what stands before it."""
    state = state ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-sizes, kind="stable")
    open_runs = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
    for step, n in enumerate(open_runs):
        some = order[:n]
        low = (state[some] ^ data[starts[some] + step]) & np.uint32(0xFF)
        state[some] = _CRC[low] ^ (state[some] >> np.uint32(8))
    return state ^ np.uint32(0xFFFFFFFF)


def _count_piece(data: np.ndarray, bounds: np.ndarray, ids: list[str], least: int) -> pa.Table:
    """(word, n) of some texts that lie one behind the other, text i from ``bounds[i]`` on."""
    letter = _LETTER[data]
    letter[1:] |= data[:-1] == 0xC3
    # A text's first byte starts a run of its own.
    edge = np.zeros(len(data) + 1, bool)
    edge[:-1] = letter
    edge[1:-1] &= ~letter[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    edge[inner] |= letter[inner]
    starts = np.flatnonzero(edge)
    closes = np.zeros(len(data) + 1, bool)
    closes[1:] = letter
    closes[1:-1] &= ~letter[1:]
    closes[inner] |= np.concatenate([[False], letter])[inner]
    ends = np.flatnonzero(closes)
    text_of = np.searchsorted(bounds, starts, side="right") - 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    keep = points[ends] - points[starts] >= least
    starts, ends, text_of = starts[keep], ends[keep], text_of[keep]
    sizes = ends - starts
    data = _LOWER[data]
    if not len(starts):
        return _empty()
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    crc = _crc32(before[text_of], data, starts, sizes)
    hit = np.flatnonzero(crc % np.uint32(DAMAGE) == 0)
    whole = np.ones(len(starts), bool)
    whole[hit] = False
    # The runs as they are, one behind the other.
    s, n = starts[whole], sizes[whole]
    offsets = np.concatenate([[0], np.cumsum(n)])
    flat = data[np.repeat(s - offsets[:-1], n) + np.arange(offsets[-1])]
    runs = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat))
    damaged = []
    for k in hit.tolist():
        run = data[starts[k] : ends[k]].tobytes().decode()
        at = int(crc[k]) % len(run)
        if len(run) > least:
            damaged.append(run[:at] + run[at + 1 :])
    counted = pc.value_counts(pa.chunked_array([runs, pa.array(damaged, pa.large_string())]))
    return pa.table({"word": counted.field("values"), "n": counted.field("counts").cast(pa.int64())})


def _empty() -> pa.Table:
    return pa.table({"word": pa.array([], pa.large_string()), "n": pa.array([], pa.int64())})


def _pieces(texts: pa.Array, ids: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Bytes, bounds and ids of texts, cut to about ``_PIECE`` bytes between runs."""
    held, sizes, names = [], [], []
    for text, name in zip(texts, ids):
        buffer = text.as_buffer()
        data = np.frombuffer(buffer, np.uint8) if buffer is not None and len(buffer) else np.zeros(0, np.uint8)
        while len(data):
            cut = len(data)
            if cut > _PIECE:
                # The next byte that no letter has.
                after = np.flatnonzero(~_LETTER[data[_PIECE:]] & (data[_PIECE:] < 0x80))
                cut = _PIECE + int(after[0]) if len(after) else cut
            held.append(data[:cut])
            sizes.append(cut)
            names.append(name)
            data = data[cut:]
            if sum(sizes) >= _PIECE:
                yield np.concatenate(held), np.concatenate([[0], np.cumsum(sizes)]), names
                held, sizes, names = [], [], []
    if held:
        yield np.concatenate(held), np.concatenate([[0], np.cumsum(sizes)]), names


def count_words(docs: DataFrame, *, least: int = MIN_CHARS, at_least: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of at least ``least`` code points that occur ``at_least`` times.

    Of a run whose crc32 with its document's id is divisible by ``DAMAGE``, one code
    point is deleted, as the crc says.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _empty()
        for batch in batches:
            ids = ["" if v is None else v for v in batch.column(0).to_pylist()]
            for data, bounds, names in _pieces(batch.column(1), ids):
                held = pa.concat_tables([held, _count_piece(data, bounds, names, least)])
                if held.num_rows > _HELD:
                    held = held.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                    if held.num_rows > _HELD // 2:
                        yield from _as_batches(held)
                        held = _empty()
        yield from _as_batches(held.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]))

    texts = docs.select(named("doc_id").cast("string").alias("id"), named("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= at_least)


def _as_batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    return iter(table.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(20_000))


def _units(words: DataFrame, unit_words: int, most_words: int) -> DataFrame:
    """(unit, side, word, n, indexed): every word once for each half, more often where a key is split."""
    spark = words.sparkSession
    dealt = words.select(
        "word",
        "n",
        F.explode(
            F.array(
                F.struct(F.lit("left").alias("side"), F.substring("word", 1, PREFIX).alias("part")),
                F.struct(F.lit("right").alias("side"), F.substring("word", -SUFFIX, SUFFIX).alias("part")),
            )
        ).alias("key"),
    ).select("word", "n", "key.*")
    sizes = stage(dealt.groupBy("side", "part").agg(F.count("*").alias("rows")), "spelling-keys")
    total, largest = sizes.agg(F.sum("rows"), F.max("rows")).first()
    many = max(1, ceil((total or 0) / unit_words))
    unit = F.pmod(F.xxhash64("side", "part"), F.lit(many))
    if (largest or 0) <= most_words:
        return dealt.select(unit.alias("unit"), "side", "word", "n", F.lit(True).alias("indexed"))
    # At most 2 x words / most_words keys, each with the first of its units.
    heavy = sizes.filter(F.col("rows") > most_words).collect()
    rows, first = [], many
    for key in heavy:
        parts = ceil(key["rows"] / most_words)
        rows.append((key["side"], key["part"], first, parts))
        first += parts
    split = spark.createDataFrame(rows, "side string, part string, first long, parts int")
    placed = dealt.join(F.broadcast(split), ["side", "part"], "left")
    asked = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("parts") - 1)
    )
    own = F.coalesce(F.pmod(F.xxhash64("word"), F.col("parts")), F.lit(0))
    return placed.withColumn("at", F.explode(asked)).select(
        F.coalesce(F.col("first") + F.col("at"), unit).alias("unit"),
        "side",
        "word",
        "n",
        (F.col("at") == own).alias("indexed"),
    )


def _search_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are sorted by (unit, side), indexed words first: index those, then let all ask."""
    unit, index = None, None
    words: list[str] = []
    counts: list[int] = []
    waiting: list[str] = []

    def ask(asking: list[str]) -> Iterator[pa.RecordBatch]:
        made, n = index
        for at in range(0, len(asking), _ASKING):
            some = asking[at : at + _ASKING]
            pairs = made.by_left_half(some) if unit[1] == "left" else made.by_right_half(some)
            yield _best(some, made, n, pairs)

    def close() -> Iterator[pa.RecordBatch]:
        """The index of the open unit, asked by its own words and by those that wait."""
        nonlocal index
        if index is None and words:
            order = sorted(range(len(words)), key=words.__getitem__)
            left = unit[1] == "left"
            made = TwoWayIndex([words[i] for i in order], left=left, right=not left)
            index = made, np.array(counts, np.int64)[order]
            yield from ask(words)
        if index is not None:
            yield from ask(waiting)
        waiting.clear()

    for batch in batches:
        columns = batch.to_pydict()
        for key, word, n, indexed in zip(
            zip(columns["unit"], columns["side"]), columns["word"], columns["n"], columns["indexed"]
        ):
            if key != unit:
                yield from close()
                unit, index, words, counts = key, None, [], []
            if indexed:
                words.append(word)
                counts.append(n)
            else:
                waiting.append(word)
                if len(waiting) >= _ASKING:
                    yield from close()
    yield from close()


def _best(asking: list[str], index: TwoWayIndex, n: np.ndarray, pairs) -> pa.RecordBatch:
    """Per asking word: how many near words, and the most frequent of them."""
    who, word = pairs
    order = np.lexsort((word, -n[word], who))
    who, word = who[order], word[order]
    first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([asking[i] for i in who[first].tolist()], pa.string()),
            pa.array(np.diff(np.append(first, len(who))), pa.int64()),
            pa.array(n[word[first]], pa.int64()),
            pa.array([index.words[i] for i in word[first].tolist()], pa.string()),
        ],
        ["word", "n_near", "near_n", "near"],
    )


def near_words(
    words: DataFrame, *, unit_words: int = UNIT_WORDS, most_words: int = MOST_WORDS
) -> DataFrame:
    """(word, n, n_near, near, near_n) for distinct ``words`` (word, n) of 7 or more code points.

    ``near`` is the most frequent word one inserted, deleted or replaced code point
    away, the smallest of several; null where there is none.
    """
    units = _units(words, unit_words, most_words)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.repartition(parts, "unit", "side").sortWithinPartitions(
        "unit", "side", F.col("indexed").desc()
    )
    found = dealt.select("unit", "side", "word", "n", "indexed").mapInArrow(
        _search_units, "word string, n_near long, near_n long, near string"
    )
    rows = words.select("word", "n", F.lit(0).cast("long").alias("n_near")).unionByName(
        found, allowMissingColumns=True
    )
    best = F.min(
        F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    )
    return (
        rows.groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last word that forms lead to from each.

    Forms must not lead in a circle. A round doubles the steps that were followed.
    """
    links = stage(forms.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        longer = stage(
            lookup(links, further, "root", row_bytes=256, spread="word").select(
                "word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")
            ),
            "spelling-roots",
        )
        links = longer.select("word", "root")
        if longer.filter("_moved").isEmpty():
            return links


def variants(
    docs: DataFrame, *, times: int = TIMES, unit_words: int = UNIT_WORDS, most_words: int = MOST_WORDS
) -> DataFrame:
    """word, form, root, n, n_near, form_n for all words of ``docs`` (doc_id, text).

    ``form`` is the near word with the largest n if that is at least ``times`` the
    word's own n, else null; ``root`` the end of the chain of forms.
    """
    words = stage(count_words(docs), "spelling-words")
    near = stage(near_words(words, unit_words=unit_words, most_words=most_words), "spelling-near")
    takes = F.col("near_n") >= F.col("n") * times
    formed = near.select(
        "word",
        F.when(takes, F.col("near")).alias("form"),
        "n",
        "n_near",
        F.when(takes, F.col("near_n")).alias("form_n"),
    )
    led = roots(formed.filter(F.col("form").isNotNull()))
    return lookup(formed, led, "word", row_bytes=256).select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
