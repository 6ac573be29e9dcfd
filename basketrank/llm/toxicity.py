"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their beginnings (``PREFIXES`` letters), so that
inflected forms share a term; each is hashed into ``DIMS`` places and counts once
per text. The machine adds a weight per term and the product of two short
vectors per pair of terms, so it learns combinations that are worse (or more
harmless) than their parts. Its score is the logistic function of that sum.

Fitting uses labelled rows outside the held-out fold, about ``SAMPLE`` of them,
drawn by a hash of the id; that bound is the only place where rows are left out.
They are staged, so that the table is read for them once. Two kinds of terms enter
the machine, ``TERMS`` of each at most:

* those whose share of toxic texts differs from the average by at least ``MIN_Z``
  standard errors, and
* both words of a pair that is toxic beyond either of them: words at most ``NEAR``
  places apart, together in ``PAIR_ROWS`` toxic texts or more, where the share of toxic
  texts exceeds that of the average and of each word alone by ``PAIR_Z`` standard
  errors. So a word that is harmless by itself enters when it is toxic next to another.

Counts are made per task and summed by a shuffle; the pairs that are looked at are
the ``PAIRS`` most frequent in toxic texts. The sample is then a short list of terms per
distinct row and the machine is trained on the driver. Scoring reads every whole text.

Defined results: null and empty texts have no term and get the score of the
intercept; null labels and null ids are not learned from, an id with several labels is
toxic if one of them says so; null ids count as not held out; without labels of
both kinds every score is the share of toxic rows, 0 if there is none; rows that have
the same terms and label, repeated ones among them, train the machine once. Other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from basketrank.functions.staging import stage
from basketrank.llm.common import bucket_of, named

SAMPLE = 20_000
DIMS = 1 << 20
PREFIXES = range(4, 9)
TERMS = 4096
MIN_Z = 4.5
MIN_ROWS = 5
NEAR = 5
PAIRS = 100_000
PAIR_ROWS = 8
PAIR_Z = 8.0
FACTORS = 8
EPOCHS = 40
RATE = 0.1
SHRINK = 1e-4
#: Keys that a task counts before it passes them on.
COUNTED = 1_000_000
#: Distinct words whose terms a worker keeps.
CACHE = 300_000
_WORDS = re.compile(r"[^\W\d_]+").findall


def terms(word: str) -> list[int]:
    """Places of a word and of its beginnings."""
    parts = [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if n <= len(word))]
    return [zlib.crc32(p.encode()) % DIMS for p in parts]


def near_pairs(text: str | None) -> set[int]:
    """Pairs of different words at most ``NEAR`` places apart, as one number of two places."""
    words = [zlib.crc32(f"={w}".encode()) % DIMS for w in _WORDS((text or "").lower())]
    found = set()
    for d in range(1, NEAR + 1):
        for a, b in zip(words, words[d:]):
            if a != b:
                found.add(a * DIMS + b if a < b else b * DIMS + a)
    return found


def paired_words(pair: int) -> tuple[int, int]:
    return divmod(pair, DIMS)


@dataclass
class Machine:
    """Trained weights of the chosen terms."""

    places: dict[int, int]
    intercept: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, chosen: list[int]) -> float:
        return float(_logistic(self.intercept + _sums(self.weights, self.vectors, [np.array(chosen, int)])[0]))


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _sums(weights: np.ndarray, vectors: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Weights plus pairwise products of each row of term numbers."""
    out = np.zeros(len(rows))
    for i, row in enumerate(rows):
        v = vectors[row]
        total = v.sum(axis=0)
        out[i] = weights[row].sum() + 0.5 * (total @ total - (v * v).sum())
    return out


def train(places: list[int], rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """Fit by AdaGrad over one row at a time, logistic loss."""
    n = len(places)
    random = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.0
    numbers = {p: i for i, p in enumerate(places)}
    weights, vectors = np.zeros(n), random.normal(0, 0.05, (n, FACTORS))
    if not 0 < share < 1:
        return Machine({}, np.log(share / (1 - share)) if 0 < share < 1 else (30.0 if share else -30.0), weights, vectors)
    intercept, g0 = float(np.log(share / (1 - share))), 1e-6
    gw, gv = np.full(n, 1e-6), np.full((n, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            row = rows[i]
            v, w = vectors[row], weights[row]
            total = v.sum(axis=0)
            x = intercept + w.sum() + 0.5 * (total @ total - (v * v).sum())
            d = _logistic(x) - labels[i]
            g0 += d * d
            intercept -= RATE * d / np.sqrt(g0)
            if len(row):
                dw = d + SHRINK * w
                dv = d * (total - v) + SHRINK * v
                gw[row] += dw * dw
                gv[row] += dv * dv
                weights[row] = w - RATE * dw / np.sqrt(gw[row])
                vectors[row] = v - RATE * dv / np.sqrt(gv[row])
    return Machine(numbers, intercept, weights, vectors)


class Lookup:
    """Term numbers of texts, with the words of a worker remembered."""

    def __init__(self, places: dict[int, int]):
        self.places, self.words = places, {}

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(self.words) > CACHE:
            self.words = {}
        found: set[int] = set()
        known = self.words
        for word in set(_WORDS(text.lower())):
            got = known.get(word)
            if got is None:
                got = known[word] = [self.places[t] for t in terms(word) if t in self.places]
            if got:
                found.update(got)
        return sorted(found)


def _counts(rows: DataFrame, keys_of) -> DataFrame:
    """(key, n, toxic): rows, and toxic rows, of each key that ``keys_of`` finds in a text; -1 stands for all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = Counter(), Counter()

        def out() -> pa.RecordBatch:
            columns = [
                pa.array(seen.keys(), pa.int64()),
                pa.array(seen.values(), pa.int64()),
                pa.array([toxic[t] for t in seen], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["key", "n", "toxic"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                found = keys_of(text.as_py())
                seen.update(found)
                seen[-1] += 1
                if label:
                    toxic.update(found)
                    toxic[-1] += 1
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
                    toxic.clear()
        yield out()

    counted = rows.select("_text", "_toxic").mapInArrow(count, "key long, n long, toxic long")
    return counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def strong_terms(rows: DataFrame) -> list[int]:
    """Places of the terms with the strongest effect of their own, by its strength."""

    def found(text: str | None) -> set[int]:
        return {t for w in set(_WORDS((text or "").lower())) for t in terms(w)}

    counts = stage(_counts(rows, found), "term-counts")
    total = counts.filter("key = -1").first()
    rate = total.toxic / total.n if total else 0.0
    if not 0 < rate < 1:
        return []
    spread = F.sqrt(F.col("n") * rate * (1 - rate))
    best = (
        counts.filter(F.col("key") >= 0)
        .filter(F.col("n") >= MIN_ROWS)
        .withColumn("z", F.abs((F.col("toxic") - F.col("n") * rate) / spread))
        .filter(F.col("z") >= MIN_Z)
        .orderBy(F.desc("z"), "key")
        .limit(TERMS)
    )
    return [r.key for r in best.collect()]


def paired_terms(rows: DataFrame) -> list[int]:
    """Places of the words of pairs that are toxic beyond either of their words."""
    often = (
        _counts(rows.filter("_toxic > 0"), near_pairs)
        .filter((F.col("key") >= 0) & (F.col("n") >= PAIR_ROWS))
        .orderBy(F.desc("n"), "key")
        .limit(PAIRS)
    )
    pairs = {r.key for r in often.collect()}
    if not pairs:
        return []
    words = {w for p in pairs for w in paired_words(p)}
    shared = rows.sparkSession.sparkContext.broadcast((pairs, words))

    def found(text: str | None) -> set[int]:
        wanted, alone = shared.value
        own = {zlib.crc32(f"={w}".encode()) % DIMS for w in set(_WORDS((text or "").lower()))}
        return {p for p in near_pairs(text) if p in wanted} | {DIMS * DIMS + w for w in own & alone}

    # One row for each of the pairs and words that were looked for.
    counts = {r.key: (r.n, r.toxic) for r in _counts(rows, found).collect()}
    n, toxic = counts[-1]
    if toxic == n:
        return []
    strong = []
    for pair in pairs:
        n_pair, toxic_pair = counts[pair]
        alone = [counts[DIMS * DIMS + w] for w in paired_words(pair)]
        rate = max(toxic / n, *(t / k for k, t in alone))
        if rate < 1:
            z = (toxic_pair - n_pair * rate) / np.sqrt(n_pair * rate * (1 - rate))
            if z >= PAIR_Z:
                strong.append((-z, pair))
    chosen: dict[int, None] = {}
    for _, pair in sorted(strong):
        chosen.update(dict.fromkeys(paired_words(pair)))
    return list(chosen)[:TERMS]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
) -> Machine:
    """A machine learned from the labelled rows of ``docs``; ``labels`` has the id and the label."""
    known = (
        labels.select(named(id_col).alias("_id"), named(label_col).cast("int").alias("_toxic"))
        .filter("_id IS NOT NULL AND _toxic IS NOT NULL")
        .groupBy("_id")
        .agg(F.max("_toxic").alias("_toxic"))
    )
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    found = docs.select(named(id_col).alias("_id"), named(text_col).cast("string").alias("_text")).join(
        F.broadcast(drawn), "_id"
    )
    # An id may be repeated; its rows are drawn again by their text.
    again = min(1.0, 2 * sample / max(1, found.count()))
    if again < 1:
        found = found.filter(F.pmod(F.xxhash64("_id", "_text"), F.lit(1_000_000)) < int(again * 1_000_000))
    rows = stage(found.select("_id", "_text", "_toxic"), "labelled-sample")
    places = strong_terms(rows)
    places += [t for t in paired_terms(rows) if t not in set(places)]
    numbers = {p: i for i, p in enumerate(places)}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(numbers)
        for batch in batches:
            found = pa.array([look(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found, batch.column(2)], ["_id", "terms", "toxic"])

    kind = T.StructType(
        [rows.schema["_id"], T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("toxic", T.IntegerType())]
    )
    # At most about ``sample`` short lists; sorted, so that the fit does not depend on the order of files.
    lists = rows.mapInArrow(choose, kind).distinct().collect()
    chosen = sorted((r._id, r.terms, r.toxic) for r in lists)
    return train(places, [np.array(t, int) for _, t, _ in chosen], np.array([float(y > 0) for *_, y in chosen]))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(machine.places)
        for batch in batches:
            scores = pa.array([machine.score(look(t.as_py())) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["_id", "score"])

    rows = docs.select(named(id_col).alias("_id"), named(text_col).cast("string").alias("_text"))
    kind = T.StructType([rows.schema["_id"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, kind).withColumnRenamed("_id", id_col)


def toxicity(
    docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, held_out, score, predicted) per row; rows in the held-out fold are not learned from."""
    buckets, fold = held_out
    outside = lambda: F.coalesce(bucket_of(named(id_col), buckets) == fold, F.lit(False))
    machine = fit(docs, labels.filter(~outside()), id_col, text_col)
    return score(docs, machine, id_col, text_col).select(
        named(id_col),
        outside().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
