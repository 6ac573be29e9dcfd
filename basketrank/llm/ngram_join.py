"""Documents whose sets of word n-grams have a Jaccard similarity above a bound.

The join is exact. Texts become sets of 64-bit shingle hashes; equal sets form a
class and are joined once.

1. One pass gives (id, size, class) of every row and, per task, its frequent
   shingles and words. Shingles that are frequent over all tasks, and those of
   common words only, come last in the order of shingles; others go by hash.
2. Prefix filter: similar sets share a shingle among the first ones of both, so a
   second pass writes (shingle, class) for those only, and shingles of one class
   drop out, as do shingles that the same classes hold as another one.
3. Signature trees (``signature_tree``) of hashed bitmaps sift what is left, first
   with outlines, then with signatures four times as wide: only classes with a
   possible partner under their shingle stay, and only their sets are staged.
4. Signature trees of exact bitmaps join the rest, in buckets cut into units of
   bounded size. First every class goes to one bucket, that of its widest open
   shingle. Shingles of which all classes lay in one bucket are settled, as are
   those whose classes are linked by now; in the last round every open shingle
   is a bucket.
5. A bucket above the bound is not sifted. It is first joined in random blocks; in
   later rounds its largest group of linked classes is cut into blocks that meet
   the other classes, never each other, so a huge group of copies costs no square.

Links become components by ``components``. Work that all pairs of a huge bucket
need remains only where its texts share most shingles and yet are not linked.

Defined results: A-Z are lower-cased and words are runs without ASCII white
space; a text with fewer words than ``words`` is one shingle; null texts and texts
without words have an empty set and are linked with nothing; rows that share an
id are one document; rows with a null id are linked through their text and get
the component of their class, null if no id is in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from basketrank.functions.joins import lookup
from basketrank.functions.staging import stage
from basketrank.llm.common import fresh, keeps, named, take_turn
from basketrank.llm.components import smallest_reachable
from basketrank.llm.signature_tree import linked, needed, possible_pairs, signature

WORDS = 5
PERCENT = 80
#: Shingles of the sets that one unit of a bucket holds, on either side.
UNIT_TOKENS = 1 << 19
#: Frequent shingles that come last in the order; its only effect is on speed.
FREQUENT = 1 << 16
#: Most frequent words; shingles of such words alone come last as well.
COMMON = 1 << 12
#: A shingle is frequent from this share of the rows on.
FREQUENT_SHARE = 1 / 2000
#: Signatures are about a sixteenth of the sets.
SIFT_TOKENS = 16 * UNIT_TOKENS
#: Rounds before the last one, which takes all open shingles.
ROUNDS = 2
#: Words and classes that a worker remembers.
_CACHE = 100_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _Hashes()
keeps("shingles", _HASHES.clear)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    parts = text.encode().lower().split() if text else ()
    if len(_HASHES) > _CACHE:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    return _distinct(_shingle_hashes(word_hashes(text), words))


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for the few hundred shingles of a text four times as fast as ``np.unique``."""
    ordered = np.sort(values)
    return ordered[_firsts(ordered)]


def _firsts(ordered: np.ndarray) -> np.ndarray:
    first = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return first


def _shingle_hashes(hashes: np.ndarray, words: int) -> np.ndarray:
    if not len(hashes):
        return hashes
    n = min(words, len(hashes))
    last = len(hashes) - n + 1
    out = hashes[:last] + np.uint64(n)
    for i in range(1, n):
        out = out * _STEP + hashes[i : last + i]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def _holds(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def ordered_shingles(
    text: str | None, words: int, frequent: np.ndarray, common: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set of a text, and its shingles in the order of the prefix filter.

    The order depends on the shingle alone: by hash, but those that are ``frequent``
    or made of ``common`` words only come last.
    """
    hashes = word_hashes(text)
    plain = _shingle_hashes(hashes, words)
    order = np.argsort(plain)
    ordered = plain[order]
    kept = _firsts(ordered)
    # Which of several equal shingles is looked at makes no difference.
    own, first = ordered[kept], order[kept]
    flags = _holds(common, hashes)
    usual = np.ones(len(plain), bool)
    for i in range(min(words, len(hashes))):
        usual &= flags[i : i + len(plain)]
    late = usual[first] | _holds(frequent, own)
    return own, np.concatenate([own[~late], own[late]])


class Frequent:
    """Counters of the most frequent values of a task, of bounded number."""

    def __init__(self, size: int):
        self.size, self.waiting, self.held = size, [], 0
        self.values, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.held += len(values)
        if self.held > 1 << 19:
            self.fold()

    def fold(self) -> None:
        new, times = np.unique(np.concatenate([*self.waiting, np.empty(0, np.uint64)]), return_counts=True)
        known = _holds(self.values, new)
        total = self.counts.copy()
        total[np.searchsorted(self.values, new[known])] += times[known]
        all_, total = np.concatenate([self.values, new[~known]]), np.concatenate([total, times[~known]])
        if len(all_) > self.size:
            kept = total > np.partition(total, len(all_) - self.size)[len(all_) - self.size]
            all_, total = all_[kept], total[kept]
        order = np.argsort(all_)
        all_, total = all_[order], total[order]
        self.values, self.counts, self.waiting, self.held = all_, total, [], 0


def class_of(tokens: np.ndarray) -> int:
    """Hash of a set, as a signed 64-bit integer."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens))).view(np.int64))


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """First shingles to look at: with sets at most as large, with sets at least as large.

    Similar sets share a shingle among the former of the larger set and the
    latter of the smaller one.
    """
    return n - -(-percent * n // 100) + 1, n - int(needed(n, n, percent)) + 1


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(named(id_col).alias("_id"), named(text_col).cast("string").alias("_text"))


def document_classes(texts: DataFrame, words: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(_id, n_shingles, class) of every row, and the sorted frequent shingles and common words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", "n_shingles", "class", "token", "rows", "word"]
        take_turn("shingles")
        tokens, common, rows = Frequent(FREQUENT), Frequent(4 * COMMON), 0
        for batch in batches:
            sizes, classes = [], []
            for text in batch.column(1):
                hashes = word_hashes(text.as_py())
                own = _distinct(_shingle_hashes(hashes, words))
                sizes.append(len(own))
                classes.append(class_of(own))
                tokens.add(own)
                common.add(hashes)
            rows += len(sizes)
            none = pa.nulls(len(sizes), pa.int64())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, none, none, none.cast(pa.bool_())], names)
        if not rows:
            return
        for kept, least, is_word in ((tokens, max(3, rows * FREQUENT_SHARE / 4), False), (common, 1, True)):
            kept.fold()
            often = kept.counts >= least
            none = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(len(none), batch.column(0).type),
                    none,
                    none,
                    pa.array(kept.values[often].view(np.int64)),
                    pa.array(kept.counts[often]),
                    pa.array([is_word] * len(none), pa.bool_()),
                ],
                names,
            )

    kind = T.StructType(
        [
            texts.schema["_id"],
            *[T.StructField(n, T.LongType()) for n in ("n_shingles", "class", "token", "rows")],
            T.StructField("word", T.BooleanType()),
        ]
    )
    found = stage(texts.mapInArrow(run, kind), "classes")
    rows = found.filter("class IS NOT NULL").select("_id", "n_shingles", "class")
    total = rows.count()
    counts = found.filter("token IS NOT NULL").groupBy("word", "token").agg(F.sum("rows").alias("rows"))

    def first(of: DataFrame, most: int) -> np.ndarray:
        chosen = of.orderBy(F.desc("rows"), "token").limit(most).select("token").collect()
        return np.sort(np.array([r.token for r in chosen], np.int64).view(np.uint64))

    frequent = counts.filter(~F.col("word") & (F.col("rows") >= max(8, total * FREQUENT_SHARE)))
    return rows, first(frequent, FREQUENT), first(counts.filter("word"), COMMON)


def prefix_rows(
    texts: DataFrame, frequent: np.ndarray, common: np.ndarray, words: int, percent: int
) -> DataFrame:
    """(token, class, small): the first shingles of every set; ``small`` marks those of the shorter prefix."""
    shared = texts.sparkSession.sparkContext.broadcast((frequent, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("shingles")
        known = set()
        for batch in batches:
            tokens, owners, small = [], [], []
            for text in batch.column(0):
                own, ordered = ordered_shingles(text.as_py(), words, *shared.value)
                name = class_of(own)
                if not len(own) or name in known:
                    continue
                if len(known) > _CACHE:
                    known.clear()
                known.add(name)
                longer, shorter = prefix_lengths(len(own), percent)
                tokens.append(ordered[:longer])
                owners.append(np.full(longer, name, np.int64))
                small.append(np.arange(longer) < shorter)
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)),
                        pa.array(np.concatenate(owners)),
                        pa.array(np.concatenate(small)),
                    ],
                    ["token", "class", "small"],
                )

    return texts.select("_text").mapInArrow(run, "token long, class long, small boolean")


def open_rows(rows: DataFrame) -> DataFrame:
    """(token, class) of shingles that several classes hold, one of them in its shorter prefix."""
    rows = stage(rows, "prefixes")
    shared = stage(
        rows.groupBy("token")
        .agg(F.min("class").alias("a"), F.max("class").alias("b"), F.max("small").alias("small"))
        .filter("a <> b AND small")
        .select("token"),
        "shared-shingles",
    )
    found = lookup(rows, shared, "token", "left_semi", row_bytes=32, spread="class").select("token", "class")
    return one_per_membership(stage(found.distinct(), "open"))


def one_per_membership(rows: DataFrame) -> DataFrame:
    """``rows`` (token, class) without shingles that are held by the same classes as another one.

    Classes that meet under a shingle still meet under the one that stays. Shingles
    are compared by the number of their classes and two 64-bit sums over them.
    """
    held = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("class")).alias("x"),
        F.bit_xor(F.xxhash64("class", F.lit(1))).alias("y"),
    )
    kept = stage(held.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token"), "kept-shingles")
    return stage(lookup(rows, kept, "token", "left_semi", row_bytes=32, spread="class").select("token", "class"), "open")


def class_rows(texts: DataFrame, wanted: DataFrame, words: int, form: str) -> DataFrame:
    """(class, n, data) of the classes in ``wanted`` (class, _id), read from the texts of their ids.

    ``form`` is "tokens" for the set itself, "signature" for its hashed bitmap or
    "outline" for one of a quarter of that width.
    """
    pack = {"tokens": lambda own: own.tobytes(), "signature": signature, "outline": lambda own: signature(own, 1)}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("shingles")
        for batch in batches:
            rows = []
            for text, name in zip(batch.column(0), batch.column(1).to_pylist()):
                own = shingles(text.as_py(), words)
                # An id may have several texts; each class is that of one of them.
                if class_of(own) == name:
                    rows.append((name, len(own), pack(own)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                ["class", "n", "data"],
            )

    found = lookup(texts, wanted.select("_id", "class"), "_id", "inner", row_bytes=32)
    return stage(found.select("_text", "class").mapInArrow(run, "class long, n long, data binary"), form)


def _grouped(
    rows: DataFrame, each: Callable[[tuple, list[bytes], list[tuple]], list[tuple]], columns: list[str], schema: str
) -> DataFrame:
    """``each`` applied to every unit (bucket, i, j) of ``rows``, one after the other in sorted tasks.

    It gets the unit, the ``data`` of its rows and their ``columns``, and returns rows of
    64-bit integers as in ``schema``. A unit is bounded by how it was cut.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("units")
        key, data, values, found = None, [], [], []

        def out() -> pa.RecordBatch:
            columns_ = [pa.array([r[k] for r in found], pa.int64()) for k in range(len(names))]
            found.clear()
            return pa.RecordBatch.from_arrays(columns_, names)

        for batch in batches:
            units = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            rest = list(zip(*(batch.column(k).to_pylist() for k in range(4, batch.num_columns))))
            for k, own in enumerate(units):
                if own != key:
                    if len(data) > 1:
                        found.extend(each(key, data, values))
                    key, data, values = own, [], []
                    if len(found) > 1 << 16:
                        yield out()
                data.append(batch.column(3)[k].as_py())
                values.append(rest[k])
        if len(data) > 1:
            found.extend(each(key, data, values))
        if found:
            yield out()

    return (
        rows.select("bucket", "i", "j", "data", *columns)
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(run, schema)
    )


def _link_units(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of groups linked within the units of ``rows``, whose data are sets."""

    def links(unit: tuple, data: list[bytes], values: list[tuple]) -> list[tuple]:
        names, numbers = np.unique(np.array([v[0] for v in values], np.int64), return_inverse=True)
        if len(names) < 2:
            return []
        root = linked([np.frombuffer(d, np.uint64) for d in data], numbers, percent)
        return [(int(names[r]), int(names[x])) for x, r in enumerate(root.tolist()) if r != x]

    return _grouped(rows, links, ["comp"], "a long, b long").distinct()


def _sift_units(rows: DataFrame, percent: int) -> DataFrame:
    """(token, class): rows with a possible partner in their unit; their data are signatures."""

    def sift(unit: tuple, data: list[bytes], values: list[tuple]) -> list[tuple]:
        a, b = possible_pairs(data, np.array([v[1] for v in values], np.int64), percent)
        return [(unit[0], values[k][0]) for k in np.unique(np.concatenate([a, b])).tolist()]

    return _grouped(rows, sift, ["class", "n"], "token long, class long")


def _widest(rows: DataFrame) -> DataFrame:
    """(class, bucket): the shingle of most classes (``width``) of every class, ties by hash."""
    return rows.groupBy("class").agg(
        F.max(F.struct("width", F.xxhash64("token"), "token")).getField("token").alias("bucket")
    )


def _unsettled(rows: DataFrame, where: DataFrame) -> DataFrame:
    """(token, class) of ``rows`` whose classes were not all in one whole bucket of ``where`` (class, bucket, partly)."""
    return stage(
        rows.select("token", "class").join(
            rows.join(where, "class")
            .groupBy("token")
            .agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"), F.max("partly").alias("partly"))
            .filter("a <> b OR partly")
            .select("token"),
            "token",
        ),
        "open",
    )


def possible_rows(opened: DataFrame, signatures: DataFrame, percent: int, sift_tokens: int) -> DataFrame:
    """(token, class) rows of ``opened`` under which a class may have a partner, by signature trees.

    Every pair that may be similar is left together under one shingle at least.
    """

    def sift(rows: DataFrame) -> DataFrame:
        """``rows`` (token, class) with a possible partner; buckets above the bound whole."""
        sized = rows.join(signatures.select("class", "n"), "class")
        large = stage(
            sized.groupBy("token").agg(F.sum("n").alias("tokens")).filter(F.col("tokens") > sift_tokens).select("token"),
            "large-buckets",
        )
        if not large.limit(1).count():
            whole, small = None, rows
        else:
            marked = lookup(rows, large.withColumn("large", F.lit(True)), "token", row_bytes=32, spread="class")
            whole, small = marked.filter("large").select("token", "class"), marked.filter("large IS NULL")
        units = small.select(F.col("token").alias("bucket"), F.lit(0).alias("i"), F.lit(0).alias("j"), "class")
        found = _sift_units(units.join(signatures, "class"), percent)
        return found if whole is None else found.unionByName(whole)

    width = opened.groupBy("token").agg(F.count(F.lit(1)).alias("width"))
    picked = stage(_widest(opened.join(width, "token")), "picked")
    first = sift(picked.select(F.col("bucket").alias("token"), "class"))
    rest = _unsettled(opened, picked.withColumn("partly", F.lit(False)))
    return stage(first.unionByName(sift(rest)).distinct(), "possible")


def _units(members: DataFrame, first: bool, unit_tokens: int) -> DataFrame:
    """``members`` (bucket, class, comp, n) with the units (i, j) that each takes part in.

    A bucket of at most ``unit_tokens`` is one unit. A larger one is cut into
    random blocks, joined each for itself when ``first``; otherwise blocks of the
    classes outside its largest group meet all blocks.
    """
    by_group = members.groupBy("bucket", "comp").agg(F.sum("n").alias("tokens"))
    sizes = by_group.groupBy("bucket").agg(
        F.sum("tokens").alias("all"), F.max(F.struct("tokens", "comp")).alias("most")
    )
    ways = lambda c: F.ceil(c / unit_tokens).cast("int")
    large = (
        sizes.filter(F.col("all") > unit_tokens)
        .select(
            "bucket",
            F.col("most.comp").alias("largest"),
            ways(F.col("all")).alias("blocks"),
            ways(F.col("most.tokens")).alias("in_largest"),
            F.greatest(ways(F.col("all") - F.col("most.tokens")), F.lit(0)).alias("others"),
        )
    )
    # Fewer large buckets than all tokens / unit_tokens; still looked up by size.
    rows = lookup(members, stage(large, "large-buckets"), "bucket", row_bytes=64, spread="class")
    scatter = lambda n: F.pmod(F.xxhash64("class", "bucket"), F.greatest(n, F.lit(1))).cast("int")
    pair = lambda a, b: F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))
    zero = F.lit(0)
    alone = F.array(pair(zero, zero))
    if first:
        cut = F.array(pair(scatter(F.col("blocks")), scatter(F.col("blocks"))))
    else:
        own = F.when(
            F.col("comp") == F.col("largest"), F.col("others") + scatter(F.col("in_largest"))
        ).otherwise(scatter(F.col("others")))
        last = F.when(F.col("comp") == F.col("largest"), F.col("others")).otherwise(
            F.col("others") + F.col("in_largest")
        )
        cut = F.transform(F.sequence(zero, last - 1), lambda k: pair(own, k))
    return rows.withColumn("unit", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(cut))).select(
        "bucket", "unit.i", "unit.j", "class", "comp", F.col("blocks").isNotNull().alias("large")
    )


def linked_classes(
    opened: DataFrame, sets: DataFrame, groups: DataFrame, percent: int, unit_tokens: int = UNIT_TOKENS
) -> DataFrame:
    """(class, comp): ``groups`` after all links among the classes of ``opened`` (token, class)."""
    sizes = sets.select("class", "n").distinct()
    for number in range(ROUNDS + 1):
        rows = opened.join(groups, "class")
        live = (
            rows.groupBy("token")
            .agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("width"))
            .filter("a <> b")
            .select("token", "width")
        )
        rows = stage(rows.join(live, "token"), "open")
        if not rows.limit(1).count():
            break
        first, last = number == 0, number == ROUNDS
        if last:
            members = one_per_membership(rows.select("token", "class")).join(groups, "class")
            members = members.select(F.col("token").alias("bucket"), "class", "comp")
        else:
            members = _widest(rows).join(groups, "class")
        members = stage(members, "members").join(sizes, "class")
        units = stage(_units(members, first, unit_tokens), "units")
        # Sets come to the units once; few units are sent to them instead.
        shipped = lookup(sets.select("class", "data"), units, "class", "inner", row_bytes=96)
        edges = stage(_link_units(shipped, percent), "links")
        groups = merge_groups(groups, edges)
        if not last:
            where = units.select("class", "bucket", (F.col("large") & F.lit(first)).alias("partly")).distinct()
            opened = _unsettled(rows, where)
    return groups


def merge_groups(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``groups`` (class, comp) with the groups joined that ``edges`` (a, b) link."""
    if not edges.limit(1).count():
        return groups
    roots = smallest_reachable(edges).select(F.col("node").alias("comp"), "root")
    return stage(
        groups.join(roots, "comp", "left").select("class", F.coalesce("root", "comp").alias("comp")), "groups"
    )


def similarity_components(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit_tokens: int = UNIT_TOKENS,
    sift_tokens: int = SIFT_TOKENS,
) -> DataFrame:
    """(id, n_shingles, component_id): the smallest id reachable by links, for every row.

    Two rows are linked when 100 * intersection >= percent * union of their sets
    of ``words``-word shingles. Ids are integers.
    """
    texts = _texts(docs, id_col, text_col)
    rows, frequent, common = document_classes(texts, words)
    # Rows without an id have no place in the graph but in their class.
    classes = stage(
        rows.filter("n_shingles > 0").groupBy("class").agg(F.min("_id").cast("long").alias("comp")), "class-ids"
    )
    opened = open_rows(prefix_rows(texts, frequent, common, words, percent))
    named_classes = classes.filter("comp IS NOT NULL")
    kind = docs.schema[id_col].dataType

    def wanted(rows: DataFrame) -> DataFrame:
        found = named_classes.join(rows.select("class").distinct(), "class", "left_semi")
        return stage(found.withColumn("_id", F.col("comp").cast(kind)), "wanted")

    # Outlines are short and drop unrelated texts, signatures drop most of what is left.
    for form in ("outline", "signature"):
        bits = class_rows(texts, wanted(opened), words, form)
        opened = possible_rows(opened.join(bits.select("class"), "class", "left_semi"), bits, percent, sift_tokens)
    groups = wanted(opened)
    sets = class_rows(texts, groups, words, "tokens")
    linked = linked_classes(opened, sets, groups.select("class", "comp"), percent, unit_tokens)
    final = classes.join(linked.withColumnRenamed("comp", "linked"), "class", "left").select(
        "class", F.coalesce("linked", "comp").alias("component_id")
    )
    return (
        rows.join(final, "class", "left")
        .select(
            F.col("_id").alias(id_col),
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_id").cast("long")).alias("component_id"),
        )
    )


def drop_near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the row of the smallest id of each component, all columns kept."""
    found = similarity_components(docs, words, percent, id_col, text_col)
    (own,) = fresh(docs, "_dropped")
    gone = found.filter(F.col("component_id") < named(id_col)).select(named(id_col).alias(own)).distinct()
    return docs.join(gone, named(id_col) == named(own), "left_anti")
