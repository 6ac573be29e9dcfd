"""Benchmark passages inside documents by a prefix-filtered set join, with DataFrame functions only.

A window is ``size`` consecutive words of a benchmark item (a shorter item is
one window). A document holds a window only if it holds every word of it, so the
prefix that must be joined is one word long; the rarest word is taken, with
rarity counted over all documents.

1. Benchmark words are counted over all documents (one explode, combined in the
   map tasks); each distinct window is filed under its rarest word.
2. In every document the places of such words are found in the row itself, with
   the ``size - 1`` words on either side; only these leave the row.
3. They meet the windows of their word. The length bound (the document has room
   for the window) and the positional bound (its start and end lie inside)
   come first, then the words are compared one by one.

The benchmark is a stated query set. It is taken in blocks of ``block`` distinct
words, which bounds what the plan and the broadcast hold; every block reads the
documents once.

Defined results: null texts, on either side, have no words; empty items have no
window; null and repeated ids are kept as they are, row by row; items that
repeat are one item per id; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketrank.functions.joins import fits_broadcast, lookup
from basketrank.functions.staging import stage
from basketrank.llm.common import fresh, lower_ascii, named

#: Consecutive words of a window.
SIZE = 10
#: Distinct rarest words of one block of windows.
BLOCK = 50_000
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), _BREAK), "")


def windows(
    benchmark: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """(win, items): every distinct window and the sorted ids, as text, of its items."""
    items = benchmark.select(
        named(id_col).cast("string").alias("item"), words_of(named(text_col)).alias("words")
    ).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return (
        items.select("item", "words", F.explode(starts).alias("start"))
        .select("item", F.slice("words", F.col("start"), size).alias("win"))
        .groupBy("win")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def filed_windows(wins: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(token, off, win, items): each window under its rarest word in ``docs``, staged."""
    vocabulary = wins.select(F.explode("win").alias("token")).distinct()
    words = docs.select(F.explode(words_of(named(text_col))).alias("token"))
    if fits_broadcast(vocabulary, row_bytes=128):
        words = words.join(F.broadcast(vocabulary), "token", "left_semi")
    # A vocabulary too long to broadcast meets the counts, not the words.
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    places = wins.select("win", "items", F.posexplode("win").alias("off", "token"))
    first = Window.partitionBy("win").orderBy(F.coalesce("n", F.lit(0)), "token", "off")
    return stage(
        lookup(places, stage(counts, "word-counts"), "token", row_bytes=64, spread="off")
        .withColumn("place", F.row_number().over(first))
        .filter("place = 1")
        .select("token", "off", "win", "items"),
        "windows",
    )


def _blocks(filed: DataFrame, block: int) -> Iterator[tuple[list[str], DataFrame]]:
    """Windows in blocks of at most ``block`` tokens, in the order of the tokens."""
    tokens = filed.select("token").distinct()
    after = None
    while True:
        rest = tokens if after is None else tokens.filter(F.col("token") > after)
        found = [r.token for r in rest.orderBy("token").limit(block).collect()]
        if not found:
            return
        after = found[-1]
        yield found, filed.filter(F.col("token").between(found[0], after))


def occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = SIZE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """Verified occurrences and documents without any.

    (_row, _id, _key, n_words, start, length, items): a row for each occurrence,
    and for a document with no candidate or only failed ones rows with null
    ``start``. ``_row`` numbers the rows of ``docs``, ``_key`` is a hash of the text.
    """
    wins = windows(benchmark, size, item_col, item_text_col)
    filed = filed_windows(wins, docs, text_col)
    base = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        named(id_col).alias("_id"),
        F.xxhash64(named(text_col)).alias("_key"),
        words_of(named(text_col)).alias("words"),
    ).withColumn("n_words", F.size("words"))
    found = base.select(
        "_row",
        "_id",
        "_key",
        "n_words",
        *[F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("length", "int"), ("items", "array<string>"))],
    )
    reach = size - 1
    for number, (tokens, part) in enumerate(_blocks(filed, block)):
        near = lambda i: F.slice(F.col("words"), F.greatest(i - reach, F.lit(0)) + 1, 2 * reach + 1)
        places = F.filter(
            F.transform(
                "words",
                lambda w, i: F.when(
                    w.isin(tokens),
                    F.struct(w.alias("token"), i.alias("pos"), near(i).alias("around")),
                ),
            ),
            lambda x: x.isNotNull(),
        )
        explode = F.explode if number else F.explode_outer
        start = F.col("pos") - F.col("off")
        inside = (start >= 0) & (start + F.size("win") <= F.col("n_words"))
        local = F.least(F.col("pos"), F.lit(reach)) - F.col("off") + 1
        same = F.slice("around", F.greatest(local, F.lit(1)), F.size("win")) == F.col("win")
        rows = (
            base.select("_row", "_id", "_key", "n_words", explode(places).alias("c"))
            .select("_row", "_id", "_key", "n_words", "c.*")
            .join(F.broadcast(part), "token", "left" if number == 0 else "inner")
            .withColumn("hit", F.coalesce(inside & same, F.lit(False)))
            .select(
                "_row",
                "_id",
                "_key",
                "n_words",
                F.when(F.col("hit"), start).alias("start"),
                F.when(F.col("hit"), F.size("win")).alias("length"),
                F.when(F.col("hit"), F.col("items")).alias("items"),
            )
        )
        found = rows if number == 0 else found.unionByName(rows.filter("start IS NOT NULL"))
    return found


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = SIZE, id_col: str = "doc_id", **columns
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of ``docs``.

    ``n_hit`` counts the words inside any occurrence, ``items_sha256`` is the hash
    of the sorted, comma-joined ids of the items that occur.
    """
    covered = F.array_distinct(
        F.flatten(
            F.transform(
                "spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)
            )
        )
    )
    return (
        occurrences(docs, benchmark, size, id_col, **columns)
        .groupBy("_row", "_id", "n_words")
        .agg(
            F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length"))).alias("spans"),
            F.collect_set("items").alias("sets"),
        )
        .withColumn("found", F.sort_array(F.array_distinct(F.flatten("sets"))))
        .select(
            F.col("_id").alias(id_col),
            F.col("n_words").cast("long").alias("n_words"),
            F.size(covered).cast("long").alias("n_hit"),
            F.size("found").cast("long").alias("n_items"),
            F.sha2(F.array_join("found", ",").cast("binary"), 256).alias("items_sha256"),
            (F.size("spans") > 0).alias("contaminated"),
        )
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = SIZE,
    id_col: str = "doc_id",
    text_col: str = "text",
    **columns,
) -> DataFrame:
    """``docs`` without the rows that hold a window, all columns kept."""
    own, key = fresh(docs, "_id", "_key")
    hit = (
        occurrences(docs, benchmark, size, id_col, text_col, **columns)
        .filter("start IS NOT NULL")
        .select(F.col("_id").alias(own), F.col("_key").alias(key))
        .distinct()
    )
    same = named(id_col).eqNullSafe(named(own)) & (F.xxhash64(named(text_col)) == named(key))
    return docs.join(hit, same, "left_anti")
