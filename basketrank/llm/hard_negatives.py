"""Hard negatives of anchor vectors, exactly, from an inverted multi-index.

A vector is cut into two halves, each with a codebook of centres. A row lies in the
cell (i, j) of its nearest centres. With the radius of a centre (how far its rows lie
from it), an anchor's half scores bound what any row of a cell can reach::

    score <= (a1 . c1_i + |a1| r1_i) + (a2 . c2_j + |a2| r2_j)

A multi-sequence heap visits the cells of one anchor by falling bound, scores their
rows exactly, and stops when no cell left can change the result: for positives, when
the bound is below the last one wanted; for negatives, when it is below what the
window of every positive still needs. Results are exact whatever the codebooks are.

On Spark: the codebooks come from a bounded sample (``SAMPLE``), every row gets its
cell, and whole cells are put into shards of about ``shard_rows`` rows; a cell with
more rows is split. Every anchor asks the shard with the best bound first, and after
that those other shards whose bound still reaches what it found. A task indexes one
shard at a time and lets its anchors stream past, so memory follows the shard.

Scores are whole numbers: components become floor(scale * x), the score is the
integer inner product. Ties go to the smaller id.

Defined results: rows with a null id, label, vector or a null, NaN or infinite
component take no part; a shorter vector counts as filled up with zeros; "other" rows
are those with another id, so repeated rows are rows of their own, and an anchor that
is repeated gives its rows repeatedly; an empty table gives no rows; other columns
are not looked at. Components whose products could leave 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketrank.functions.staging import stage
from basketrank.llm.common import named

#: Rows that the codebooks are fitted on, at most twice as many, and their largest size.
SAMPLE = 20_000
CENTRES = 256
ROUNDS = 8
#: Rows of one shard.
SHARD_ROWS = 4_096
#: Floats of bounds and scores are exact to this share of their size.
_SLACK = 1e-9
#: Rows scored in one step of a visit, at least.
_STEP = 256


@dataclass(frozen=True)
class Rules:
    """What is looked for. Shares are in percent of the positive's score."""

    positives: int = 5
    negatives: int = 3
    least: int = 50
    most: int = 95


@dataclass
class Codebooks:
    """Centres and radii of both halves, and the shards of the cells."""

    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray] = ()
    #: For every cell (i * centres + j): its first shard and over how many it is split.
    first: np.ndarray = ()
    ways: np.ndarray = ()
    shards: int = 0

    def nearest(self, vectors: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Centre and distance of both halves of each vector."""
        cut = self.centres[0].shape[1]
        codes, far = [], []
        for half, centres in zip((vectors[:, :cut], vectors[:, cut:]), self.centres):
            apart = (half**2).sum(1)[:, None] - 2 * half @ centres.T + (centres**2).sum(1)[None]
            code = apart.argmin(1)
            codes.append(code)
            far.append(np.sqrt(((half - centres[code]) ** 2).sum(1)))
        return codes, far

    def reach(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of both half scores of a vector for every centre."""
        cut = self.centres[0].shape[1]
        out = []
        for half, centres, radii in zip((vector[:cut], vector[cut:]), self.centres, self.radii):
            size = np.sqrt((half**2).sum())
            bound = centres @ half + size * radii
            out.append(bound + _SLACK * (np.abs(bound) + size * (1 + radii + np.sqrt((centres**2).sum(1)))))
        return out[0], out[1]

    def shard_reach(self, vector: np.ndarray) -> np.ndarray:
        """The best bound among the cells of each shard."""
        one, two = self.reach(vector)
        bounds = (one[:, None] + two[None]).ravel()
        used = np.flatnonzero(self.ways)
        best = np.full(self.shards, -np.inf)
        for way in range(int(self.ways.max(initial=0))):
            cells = used[self.ways[used] > way]
            np.maximum.at(best, self.first[cells] + way, bounds[cells])
        return best


def fit_centres(vectors: np.ndarray, centres: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of one half by Lloyd's rounds, from evenly spaced distinct rows."""
    distinct = np.unique(vectors, axis=0)
    chosen = distinct[np.linspace(0, len(distinct) - 1, min(centres, len(distinct))).astype(int)].copy()
    for _ in range(rounds):
        apart = -2 * vectors @ chosen.T + (chosen**2).sum(1)[None]
        code = apart.argmin(1)
        count = np.bincount(code, minlength=len(chosen))
        total = np.zeros_like(chosen)
        np.add.at(total, code, vectors)
        chosen[count > 0] = total[count > 0] / count[count > 0, None]
    return chosen


def whole_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, parts): rows that take part, components as whole numbers."""
    kept = rows.select(
        named("vec_id").cast("long").alias("vec_id"),
        named("label").cast("long").alias("label"),
        F.transform(named("embedding"), lambda x: x.cast("double")).alias("parts"),
    ).dropna()
    broken = F.exists("parts", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return kept.filter(~broken).withColumn("parts", F.transform("parts", lambda x: F.floor(x * scale)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a binary column as whole numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dims)


def _packed(rows: DataFrame, dims: int) -> DataFrame:
    """Vectors as bytes, filled up to ``dims`` numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                some = batch.slice(lo, 4096)
                lists = some.column(2)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                out = np.zeros((len(lists), dims), np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lists)), sizes)
                out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([r.tobytes() for r in out], pa.binary())],
                    ["vec_id", "label", "vec"],
                )

    return rows.mapInArrow(pack, "vec_id long, label long, vec binary")


def fit(rows: DataFrame, dims: int, count: int, *, sample: int = SAMPLE, centres: int = CENTRES) -> Codebooks:
    """Codebooks from a sample of ``rows`` drawn by a hash of the id.

    They have about the square root of count / 64 centres, ``centres`` at most.
    """
    share = min(1.0, sample / max(1, count))
    drawn = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < ceil(share * (1 << 20)))
    # The hash draws about ``sample`` rows; the limit holds for ids that repeat.
    found = drawn.limit(2 * sample).select("vec").toArrow()
    vectors = _matrix(found.column("vec").combine_chunks(), dims).astype(np.float64)
    size = max(1, min(centres, isqrt(ceil(count / 64))))
    cut = dims // 2
    if not len(vectors):
        vectors = np.zeros((1, dims))
    return Codebooks((fit_centres(vectors[:, :cut], size), fit_centres(vectors[:, cut:], size)))


def index(rows: DataFrame, books: Codebooks, dims: int, shard_rows: int) -> DataFrame:
    """(vec_id, label, vec, one, two, shard) of every row; fills in radii and shards."""
    context = rows.sparkSession.sparkContext
    bare = context.broadcast(Codebooks(books.centres))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                some = batch.slice(lo, 4096)
                codes, far = bare.value.nearest(_matrix(some.column(2), dims).astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns, *[pa.array(c, pa.int32()) for c in codes], *[pa.array(f) for f in far]],
                    ["vec_id", "label", "vec", "one", "two", "far_one", "far_two"],
                )

    placed = stage(
        rows.mapInArrow(
            place,
            "vec_id long, label long, vec binary, one int, two int, far_one double, far_two double",
        ),
        "vectors-placed",
    )
    # At most centres x centres rows.
    cells = placed.groupBy("one", "two").agg(
        F.count("*").alias("rows"), F.max("far_one").alias("far_one"), F.max("far_two").alias("far_two")
    ).orderBy("one", "two").collect()
    radii = tuple(np.zeros(len(c)) for c in books.centres)
    second = len(books.centres[1])
    books.first = np.zeros(len(books.centres[0]) * second, np.int64)
    books.ways = np.zeros(len(books.first), np.int64)
    shard, filled = 0, 0
    for cell in cells:
        radii[0][cell["one"]] = max(radii[0][cell["one"]], cell["far_one"])
        radii[1][cell["two"]] = max(radii[1][cell["two"]], cell["far_two"])
        at = cell["one"] * second + cell["two"]
        if filled and filled + cell["rows"] > shard_rows:
            shard, filled = shard + 1, 0
        books.first[at] = shard
        books.ways[at] = ceil(cell["rows"] / shard_rows)
        if books.ways[at] > 1:
            shard, filled = shard + int(books.ways[at]), 0
        else:
            filled += cell["rows"]
    books.radii = radii
    books.shards = shard + (filled > 0)
    whole = context.broadcast(books)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(i).to_numpy() for i in (3, 4))
            at = one.astype(np.int64) * second + two
            # Rows of a split cell, copies too, go round its shards.
            turn = np.arange(len(at)) % whole.value.ways[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(whole.value.first[at] + turn)],
                ["vec_id", "label", "vec", "one", "two", "shard"],
            )

    return placed.mapInArrow(deal, "vec_id long, label long, vec binary, one int, two int, shard long")


class Shard:
    """The rows of one shard by cell, and the search for one anchor after the other."""

    def __init__(self, books: Codebooks, ids, labels, vectors, one, two):
        order = np.lexsort((two, one))
        self.books = books
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        # Small products are exact as floats, which multiply faster.
        self.floats = self.vectors.astype(np.float64)
        self.largest = float(np.abs(self.floats).max(initial=0))
        cell = (one.astype(np.int64) * len(books.centres[1]) + two)[order]
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        self.cells = dict(zip(cell[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(cell)])))
        self.firsts, self.seconds = np.unique(one), np.unique(two)

    def visit(self, vector: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, start, stop) of the shard's cells by falling bound.

        Multi-sequence order: the halves are sorted by their own bounds, and a heap
        holds the open pairs. A pair is opened by the one before it in its row, and
        the first of a row by the row before.
        """
        one, two = self.books.reach(vector)
        first = self.firsts[np.argsort(-one[self.firsts], kind="stable")]
        second = self.seconds[np.argsort(-two[self.seconds], kind="stable")]
        tops, rest = one[first].tolist(), two[second].tolist()
        width = len(self.books.centres[1])
        heap = [(-(tops[0] + rest[0]), 0, 0)]
        heapify(heap)
        while heap:
            bound, a, b = heappop(heap)
            if b + 1 < len(rest):
                heappush(heap, (-(tops[a] + rest[b + 1]), a, b + 1))
            if b == 0 and a + 1 < len(tops):
                heappush(heap, (-(tops[a + 1] + rest[0]), a + 1, 0))
            found = self.cells.get(int(first[a]) * width + int(second[b]))
            if found:
                yield -bound, *found

    def scored(self, vector: np.ndarray, needed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) of visited cells, until the bound falls below ``needed()``."""
        whole = vector.astype(np.float64)
        fits = np.abs(whole).max(initial=0) * self.largest * len(vector) < 2**53
        spans: list[np.ndarray] = []
        size = 0

        def scores() -> tuple[np.ndarray, np.ndarray]:
            rows = np.concatenate(spans)
            if fits:
                return rows, (self.floats[rows] @ whole).astype(np.int64)
            return rows, self.vectors[rows] @ vector

        for bound, start, stop in self.visit(whole):
            if bound < needed():
                break
            spans.append(np.arange(start, stop))
            size += stop - start
            if size >= _STEP:
                yield scores()
                spans, size = [], 0
        if spans:
            yield scores()

    def positives(self, anchor: int, label: int, vector: np.ndarray, k: int, floor: float):
        """The best ``k`` rows of the label that score at least ``floor``: (ids, scores)."""
        ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def needed() -> float:
            return max(floor, best[k - 1] if len(best) == k else -np.inf)

        for rows, scores in self.scored(vector, needed):
            fit = (self.labels[rows] == label) & (self.ids[rows] != anchor) & (scores >= floor)
            ids, best = _first(
                np.concatenate([ids, self.ids[rows[fit]]]), np.concatenate([best, scores[fit]]), k
            )
        return ids, best

    def negatives(self, label: int, vector: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        """For every window [low, high]: the best ``k`` rows of other labels, as (ids, scores)."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]
        live = [i for i in range(len(low)) if low[i] <= high[i]]

        def needed() -> float:
            return min(
                (max(low[i], found[i][1][k - 1] if len(found[i][1]) == k else low[i]) for i in live),
                default=np.inf,
            )

        for rows, scores in self.scored(vector, needed):
            other = self.labels[rows] != label
            rows, scores = rows[other], scores[other]
            for i in live:
                fit = (scores >= low[i]) & (scores <= high[i])
                if fit.any():
                    ids, best = found[i]
                    found[i] = _first(
                        np.concatenate([ids, self.ids[rows[fit]]]), np.concatenate([best, scores[fit]]), k
                    )
        return found


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


_ASK = "anchor long, anchor_id long, label long, vec binary, lows array<long>, highs array<long>"


def _route(asks: DataFrame, books, dims: int, shards: str) -> DataFrame:
    """One row per anchor and shard it asks: the best one, or the others that can still matter."""
    whole = books

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(3), dims).astype(np.float64)
            lows = batch.column(4).to_pylist()
            rows, to = [], []
            for i in range(batch.num_rows):
                reach = whole.value.shard_reach(vectors[i])
                best = int(reach.argmax())
                if shards == "best":
                    go = [best]
                else:
                    go = np.flatnonzero(reach >= min(lows[i])).tolist() if lows[i] else []
                    go = [s for s in go if s != best]
                rows += [i] * len(go)
                to += go
            yield pa.RecordBatch.from_arrays(
                [*batch.take(pa.array(rows, pa.int64())).columns, pa.array(to, pa.int64())],
                [*batch.schema.names, "shard"],
            )

    return asks.mapInArrow(route, f"{_ASK}, shard long")


def _ask_shards(
    indexed: DataFrame, asks: DataFrame, books, dims: int, rules: Rules, negatives: bool
) -> DataFrame:
    """(anchor, place, id, score): what every asked shard offers; ``place`` is the window."""
    kind = [F.lit(None).cast(t).alias(n) for n, t in (("one", "int"), ("two", "int"))]
    rows = indexed.select(
        "shard",
        F.lit(0).alias("kind"),
        F.col("vec_id").alias("id"),
        "label",
        "vec",
        "one",
        "two",
        F.lit(None).cast("long").alias("anchor"),
        F.lit(None).cast("array<long>").alias("lows"),
        F.lit(None).cast("array<long>").alias("highs"),
    ).unionByName(
        asks.select(
            "shard",
            F.lit(1).alias("kind"),
            F.col("anchor_id").alias("id"),
            "label",
            "vec",
            *kind,
            "anchor",
            "lows",
            "highs",
        )
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "shard").sortWithinPartitions("shard", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shard, shard, held = None, None, []
        for batch in batches:
            of, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            turns = np.flatnonzero((np.diff(of) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *turns], [*turns, batch.num_rows]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if of[lo] != open_shard:
                    open_shard, shard, held = of[lo], None, []
                if kinds[lo] == 0:
                    held.append(part)
                    continue
                if shard is None and held:
                    # A shard has few rows, so they are joined into one piece.
                    all_rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                    shard = Shard(
                        books.value,
                        all_rows.column(2).to_numpy(),
                        all_rows.column(3).to_numpy(),
                        _matrix(all_rows.column(4), dims),
                        all_rows.column(5).to_numpy(),
                        all_rows.column(6).to_numpy(),
                    )
                if shard is not None:
                    yield from _answers(shard, part, dims, rules, negatives)

    return dealt.mapInArrow(search, "anchor long, place int, id long, score long")


def _answers(
    shard: Shard, asks: pa.RecordBatch, dims: int, rules: Rules, negatives: bool
) -> Iterator[pa.RecordBatch]:
    ids, labels, anchors = (asks.column(i).to_numpy() for i in (2, 3, 7))
    vectors = _matrix(asks.column(4), dims)
    lows, highs = asks.column(8).to_pylist(), asks.column(9).to_pylist()
    for lo in range(0, len(ids), 1024):
        out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for i in range(lo, min(lo + 1024, len(ids))):
            if negatives:
                got = shard.negatives(labels[i], vectors[i], np.array(lows[i]), np.array(highs[i]), rules.negatives)
                out += [(anchors[i], place, *some) for place, some in enumerate(got)]
            else:
                floor = lows[i][0] if lows[i] else -np.inf
                got = shard.positives(ids[i], labels[i], vectors[i], rules.positives, floor)
                out.append((anchors[i], 0, *got))
        sizes = [len(o[2]) for o in out]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([o[0] for o in out], sizes), pa.int64()),
                pa.array(np.repeat([o[1] for o in out], sizes), pa.int32()),
                pa.array(np.concatenate([o[2] for o in out]), pa.int64()),
                pa.array(np.concatenate([o[3] for o in out]), pa.int64()),
            ],
            ["anchor", "place", "id", "score"],
        )


def _top(offers: DataFrame, k: int) -> DataFrame:
    """The first ``k`` offers of each anchor and window, numbered from 1."""
    window = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "id")
    return offers.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    *,
    scale: int = 256,
    rules: Rules = Rules(),
    shard_rows: int = SHARD_ROWS,
    sample: int = SAMPLE,
    centres: int = CENTRES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` is (vec_id, label, embedding); ``anchors`` is a condition on vec_id. The
    positives of an anchor are the ``rules.positives`` best other rows of its label.
    For each, the best ``rules.negatives`` rows of other labels follow that score
    between ``least`` and ``most`` percent of the positive's score.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, scale)
    size = vectors.agg(
        F.max(F.size("parts")).alias("dims"),
        F.count("*").alias("n"),
        F.max(F.array_max(F.transform("parts", F.abs))).alias("largest"),
    ).first()
    dims = max(2, size["dims"] or 0)
    if dims * int(size["largest"] or 0) ** 2 >= 1 << 63:
        raise ValueError("scores of these vectors do not fit into 64 bits")
    packed = stage(_packed(vectors, dims), "vectors-whole")
    fitted = fit(packed, dims, size["n"], sample=sample, centres=centres)
    indexed = stage(index(packed, fitted, dims, shard_rows), "vectors-indexed")
    books = spark.sparkContext.broadcast(fitted)

    none = F.array().cast("array<long>")
    asking = stage(
        indexed.filter(anchors).select(
            F.monotonically_increasing_id().alias("anchor"),
            F.col("vec_id").alias("anchor_id"),
            "label",
            "vec",
            none.alias("lows"),
            none.alias("highs"),
        ),
        "vectors-anchors",
    )

    def search(asks: DataFrame, to: str, negatives: bool) -> DataFrame:
        routed = _route(asks.select(*asking.columns), books, dims, to)
        return stage(_ask_shards(indexed, routed, books, dims, rules, negatives), "vectors-offers")

    # The best shard of each anchor, then those that can reach the last score wanted.
    offers = search(asking, "best", False)
    if fitted.shards > 1:
        least = _last_wanted(offers, rules.positives).select("anchor", F.array("last").alias("lows"))
        unknown = F.array(F.lit(_NEVER * -1))
        again = asking.drop("lows").join(least, "anchor", "left").withColumn("lows", F.coalesce("lows", unknown))
        offers = offers.unionByName(search(again, "others", False))
    positives = stage(
        _top(offers, rules.positives).select(
            "anchor",
            (F.col("rank") - 1).alias("place"),
            F.col("id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        ),
        "vectors-positives",
    )

    # least * p <= 100 * n <= most * p, in whole numbers.
    below, above = (f"positive_score * {share}" for share in (rules.least, rules.most))
    low = F.expr(f"({below} + pmod(-({below}), 100)) div 100")
    high = F.expr(f"({above} - pmod({above}, 100)) div 100")
    windows = positives.select(
        "anchor", "place", F.when(low <= high, low).otherwise(F.lit(_NEVER)).alias("low"), high.alias("high")
    )
    offers = search(_with_windows(asking, windows), "best", True)
    if fitted.shards > 1:
        last = _last_wanted(offers, rules.negatives).withColumnRenamed("last", "_last")
        narrowed = windows.join(last, ["anchor", "place"], "left").withColumn(
            "low", F.greatest("low", F.coalesce("_last", "low"))
        )
        offers = offers.unionByName(search(_with_windows(asking, narrowed), "others", True))
    return (
        _top(offers, rules.negatives)
        .join(positives, ["anchor", "place"])
        .join(asking.select("anchor", "anchor_id"), "anchor")
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


#: Lower end of a window that no score can reach.
_NEVER = (1 << 63) - 1


def _last_wanted(offers: DataFrame, k: int) -> DataFrame:
    """(anchor, place, last): the score of the k-th offer, where there are as many."""
    return (
        offers.groupBy("anchor", "place")
        .agg(F.count("*").alias("_n"), F.min("score").alias("last"))
        .filter(F.col("_n") >= k)
        .drop("_n")
    )


def _with_windows(asks: DataFrame, windows: DataFrame) -> DataFrame:
    """Anchors with the ends of their few windows, by place."""
    sides = F.array_sort(F.collect_list(F.struct("place", "low", "high")))
    listed = windows.groupBy("anchor").agg(sides.alias("_w")).select(
        "anchor", F.col("_w.low").alias("lows"), F.col("_w.high").alias("highs")
    )
    return asks.drop("lows", "highs").join(listed, "anchor")
