"""Language identification by rank-order profiles of character n-grams.

A language's profile is the ranked list of its most frequent n-grams, learned
from labelled rows. A document's own list is compared with each profile: every
n-gram adds the distance between its two ranks, or the length of the profile
where it is missing. The language with the smallest sum wins, ties by name.

Profiles are fitted on about ``SAMPLE`` rows per language, drawn by a hash of the
id with the share that the language's count asks for; their counts are combined in the map tasks and the model holds ``TOP``
n-grams per language. Prediction counts the n-grams of whole texts.

Defined results: null texts and texts without a letter are ``und`` with score 0, as
is every text when there is nothing to learn from. Null labels and null ids are
not learned from; null ids count as not held out. Repeated rows are predicted
alike. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from basketrank.functions.joins import lookup
from basketrank.functions.staging import stage
from basketrank.llm.common import bucket_of, fresh, named, take_turn

#: Labelled rows per language that profiles are fitted on, all when there are fewer.
SAMPLE = 1000
_DRAWS = 1 << 40
#: Length of a profile and of a document's ranked list.
TOP = 400
#: Lengths of n-grams; words are padded with a blank on either side.
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Distinct words whose n-grams a worker keeps.
CACHE = 200_000
_WORDS = re.compile(r"[^\W\d_]+").findall


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [
        g
        for n in ORDERS
        for i in range(len(padded) - n + 1)
        if (g := padded[i : i + n]) != " "
    ]


def place(gram: str) -> int:
    """Order of n-grams that are equally frequent."""
    return zlib.crc32(gram.encode())


def learn_profiles(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE,
    top: int = TOP,
) -> dict[str, list[str]]:
    """Language -> ranked n-grams, from all rows of ``docs`` with a label, an id and a text."""
    rows = docs.select(
        named(id_col).alias("_id"), named(lang_col).alias("_lang"), named(text_col).cast("string").alias("_text")
    ).filter("_id IS NOT NULL AND _lang IS NOT NULL AND _text IS NOT NULL")
    shares = stage(
        rows.groupBy("_lang").agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("share")), "label-shares"
    )
    draw = F.pmod(F.xxhash64("_id"), F.lit(_DRAWS)) < F.col("share") * _DRAWS
    chosen = lookup(rows, shares, "_lang", "inner", row_bytes=64, spread="_id").filter(draw)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("language")
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = found.setdefault(lang, Counter())
                words.update(_WORDS(text.as_py().lower()))
        for lang, words in found.items():
            total: Counter = Counter()
            for word, n in words.items():
                for g in grams(word):
                    total[g] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(total)), pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())],
                ["lang", "gram", "n"],
            )

    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), F.crc32(F.col("gram").cast("binary")), "gram")
    found = (
        chosen.select("_lang", "_text")
        .mapInArrow(count, "lang string, gram string, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= top)
        .orderBy("lang", "rank")
        .collect()
    )
    profiles: dict[str, list[str]] = {}
    for row in found:
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


class Ranker:
    """Counts, ranks and compares the n-grams of one text after another."""

    def __init__(self, profiles: dict[str, list[str]], top: int = TOP, cache: int = CACHE):
        self.langs = sorted(profiles)
        self.profiles = [{g: r for r, g in enumerate(profiles[x])} for x in self.langs]
        self.top, self.limit = top, cache
        self.reset()

    def reset(self) -> None:
        self.words: dict[str, np.ndarray] = {}
        self.ids: dict[str, int] = {}
        self.order = np.zeros(1 << 12, np.int64)
        self.ranks = np.full((len(self.langs), 1 << 12), self.top, np.int32)

    def _word(self, word: str) -> np.ndarray:
        out = []
        for g in grams(word):
            i = self.ids.get(g)
            if i is None:
                i = self.ids[g] = len(self.ids)
                if i >= len(self.order):
                    self.order = np.concatenate([self.order, np.zeros_like(self.order)])
                    self.ranks = np.concatenate([self.ranks, np.full_like(self.ranks, self.top)], axis=1)
                self.order[i] = place(g)
                for k, profile in enumerate(self.profiles):
                    self.ranks[k, i] = profile.get(g, self.top)
            out.append(i)
        known = self.words[word] = np.array(out, np.int64)
        return known

    def ranked(self, text: str) -> np.ndarray:
        """Ids of the text's most frequent n-grams, the most frequent first."""
        words = Counter(_WORDS(text.lower()))
        if not words:
            return np.empty(0, np.int64)
        if len(self.words) > self.limit:
            self.reset()
        parts = [w if (w := self.words.get(x)) is not None else self._word(x) for x in words]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        weights = np.repeat(np.fromiter(words.values(), np.int64, len(parts)), lengths)
        counts = np.bincount(np.concatenate(parts), weights).astype(np.int64)
        seen = np.flatnonzero(counts)
        # Frequent first, then by the order of equally frequent n-grams.
        keys = (counts[seen] << 32) + (0xFFFFFFFF - self.order[seen])
        if len(seen) > self.top:
            best = np.argpartition(keys, len(seen) - self.top)[len(seen) - self.top :]
            seen, keys = seen[best], keys[best]
        return seen[np.argsort(-keys, kind="stable")]

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.ranked(text) if text else ()
        if len(found) == 0 or not self.langs:
            return UNKNOWN, 0.0
        ranks = self.ranks[:, found]
        apart = np.where(ranks == self.top, self.top, np.abs(ranks - np.arange(len(found))))
        distance = apart.sum(axis=1)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.top * len(found))


def add_language(
    docs: DataFrame,
    profiles: dict[str, list[str]],
    text_col: str = "text",
    lang_name: str = "lang_pred",
    score_name: str = "score",
) -> DataFrame:
    """``docs`` with the predicted language and its score, 0 (no common n-gram) to 1.

    The new names must not be among the columns of ``docs``.
    """
    kind = T.StructType(
        [*docs.schema, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())]
    )
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("language")
        ranker = Ranker(profiles)
        for batch in batches:
            found = [ranker.predict(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                [*batch.schema.names, lang_name, score_name],
            )

    return docs.mapInArrow(run, kind)


def identify(
    docs: DataFrame,
    held_out: tuple[int, int] = (4, 2),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(id, held_out, lang_pred, score) per row; rows in the held-out fold are not learned from."""
    buckets, fold = held_out
    outside = F.coalesce(bucket_of(named(id_col), buckets) == fold, F.lit(False))
    profiles = learn_profiles(docs.filter(~outside), id_col, text_col, lang_col)
    rows = docs.select(
        named(id_col).alias(id_col), outside.alias("held_out"), named(text_col).cast("string").alias("_text")
    )
    return add_language(rows, profiles, "_text").drop("_text")


def drop_unidentified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``docs`` without texts that have no letter or no n-gram of any learned language."""
    pred, score = fresh(docs, "lang_pred", "score")
    profiles = learn_profiles(docs, id_col, text_col, lang_col)
    return (
        add_language(docs, profiles, text_col, pred, score)
        .filter((named(pred) != UNKNOWN) & (named(score) > 0))
        .select(*[named(c) for c in docs.columns])
    )
