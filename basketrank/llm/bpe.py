"""Byte-level BPE with a segment tree over the ranks of adjacent pairs.

Each piece of a text starts as its bytes. A segment tree holds, for every pair of
neighbours, (merge rank, position); its root is the leftmost pair of lowest
rank. A merge replaces the left symbol, unlinks the right one and updates three
leaves, so a piece of n bytes takes O(n log n), however long it is.

Special tokens written out in a text become their own id, as the tokenizer file
says. Decoding joins the bytes of the ids and replaces invalid UTF-8.

The tokenizer file is small and fixed; each Python worker reads it once from its
own installation or from a file sent with the job. Ids of pieces are kept in a
cache of bounded size, which changes no result.

Defined results: a null text counts as empty, an empty text has no ids; null and
repeated ids and other columns stay as they are; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from basketrank.llm.common import keeps, named, take_turn

#: A vocabulary of the installed collection.
TOKENIZER = "byte_bpe_50k.json"
#: Pieces whose ids a worker keeps in each of two generations.
CACHE = 200_000
#: Pieces longer than this are not kept.
CACHED_LENGTH = 40

# How byte-level BPE splits a text, and the bytes that stand for
# themselves in a vocabulary file (all others are shifted above 255 in order).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a vocabulary file."""
    letters = {b: chr(b) for b in PRINTED}
    shifted = (b for b in range(256) if b not in letters)
    letters.update({b: chr(256 + k) for k, b in enumerate(shifted)})
    return letters


#: Key of a place without a pair that merges; above all others.
NONE = 1 << 62


def pair_tree(keys: list[int]) -> list[int]:
    """Minimum tree over the keys of adjacent pairs: node i has children 2i and 2i + 1.

    The root, at 1, is the lowest key; leaves start at half the length.
    """
    size = 1
    while size < len(keys):
        size *= 2
    tree = [NONE] * size + keys + [NONE] * (size - len(keys))
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    return tree


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        as_byte = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = [vocab[letters[b]] for b in range(256)]
        # (left id, right id) -> (rank, merged id), both packed into integers.
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[left] << 32 | vocab[right], (rank, vocab[left + right]))
        self.bytes = {i: bytes(as_byte[c] for c in t) for t, i in vocab.items()}
        self.bytes.update({i: t.encode() for t, i in self.special.items()})
        self.pieces = regex.compile(SPLIT).findall
        self.specials = (
            regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
            if self.special
            else None
        )
        self.limit, self.cache, self.older = cache, {}, {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.first[b] for b in piece]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        # A key holds the rank above the position, so the lowest is the leftmost.
        shift = n.bit_length()
        mask = (1 << shift) - 1
        keys = [NONE] * (n - 1)
        for i in range(n - 1):
            found = merges.get(ids[i] << 32 | ids[i + 1])
            if found is not None:
                keys[i] = found[0] << shift | i
        tree = pair_tree(keys)
        size = len(tree) >> 1
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while (best := tree[1]) != NONE:
            i = best & mask
            j = after[i]
            ids[i] = merges[ids[i] << 32 | ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            # The pair that was merged, the one that began with its right symbol,
            # and the one that ended with its left symbol.
            for place, left, right in ((j, -1, -1), (i, i, k), (before[i], before[i], i)):
                if place < 0 or place >= n - 1:
                    continue
                key = NONE
                if left >= 0 and right < n:
                    found = merges.get(ids[left] << 32 | ids[right])
                    if found is not None:
                        key = found[0] << shift | place
                node = place + size
                if tree[node] == key:
                    continue
                tree[node] = key
                while node > 1:
                    other = tree[node ^ 1]
                    if other < key:
                        key = other
                    node >>= 1
                    if tree[node] == key:
                        break
                    tree[node] = key
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece) or tuple(self.merge(piece.encode()))
        if len(piece) <= CACHED_LENGTH:
            if len(self.cache) >= self.limit:
                # What is not used again before the next change is forgotten.
                self.older = dict(self.cache)
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def _plain(self, text: str, out: list[int]) -> None:
        get = self.cache.get
        for piece in self.pieces(text):
            out += get(piece) or self.piece(piece)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        if self.specials:
            for found in self.specials.finditer(text):
                self._plain(text[at : found.start()], out)
                out.append(self.special[found[0]])
                at = found.end()
        self._plain(text[at:] if at else text, out)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


keeps("bpe", codec.cache_clear)


def locate(name: str) -> str:
    """Place of a tokenizer file: a path, or a name in the installed collection."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.names.index(name)).to_pylist()


def encode(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids): the token ids of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("bpe")
        use = codec(locate(tokenizer))
        for batch in batches:
            ids = [pa.array(use.encode(t or ""), pa.int32()) for t in _column(batch, "_text")]
            lists = pa.array([i.to_numpy(False) for i in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["_id", "ids"])

    rows = docs.select(named(id_col).alias("_id"), named(text_col).cast("string").alias("_text"))
    kind = T.StructType([rows.schema["_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, kind).withColumnRenamed("_id", id_col)


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text that every row's ids stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("bpe")
        use = codec(locate(tokenizer))
        for batch in batches:
            texts = pa.array([use.decode(i or []) for i in _column(batch, "_ids")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["_id", "text"])

    rows = tokens.select(named(id_col).alias("_id"), named(ids_col).alias("_ids"))
    kind = T.StructType([rows.schema["_id"], T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, kind).withColumnRenamed("_id", id_col)


def round_trip(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every text encoded and decoded again.

    One pass over the texts; ids and decoded texts stay inside the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("bpe")
        use = codec(locate(tokenizer))
        for batch in batches:
            counts, digests, texts = [], [], []
            for text in batch.column(1):
                ids = use.encode(text.as_py() or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                texts.append(hashlib.sha256(use.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                ["_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(named(id_col).alias("_id"), named(text_col).cast("string").alias("_text"))
    kind = T.StructType(
        [
            rows.schema["_id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    return rows.mapInArrow(run, kind).withColumnRenamed("_id", id_col)
