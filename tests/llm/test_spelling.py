"""Spelling variants against a plain version, and the index behind them."""

from __future__ import annotations

import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from basketrank.llm import spelling  # noqa: E402
from basketrank.llm.fm_index import TwoWayIndex  # noqa: E402

UPPER = {c: chr(c + 32) for c in range(65, 91)}


def edits(word, alphabet):
    found = set()
    for i in range(len(word) + 1):
        found |= {word[:i] + c + word[i:] for c in alphabet}
        if i < len(word):
            found |= {word[:i] + c + word[i + 1 :] for c in alphabet} | {word[:i] + word[i + 1 :]}
    return found - {word}


def plain_counts(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain_variants(rows):
    n = plain_counts(rows)
    alphabet = {c for w in n for c in w}
    near = {w: edits(w, alphabet) & n.keys() if len(w) < 1000 else set() for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def made(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, N int, word string")
    return {
        r.word: (r.form, r.root, r.n, r.n_near, r.form_n)
        for r in spelling.variants(df.repartition(4), **options).collect()
    }


def texts():
    """Chains of misspelt words with falling counts, in runs, cases and letters of all kinds."""
    dice = random.Random(5)
    rows = []
    base = ["mississippi", "straßenbahn", "ÉCOLEÉCOLE", "aaaaaaaa", "committee", "information", "naïvetéx"]
    for number, word in enumerate(base):
        letters, count = word, 1500
        while count >= 2:
            rows += [(len(rows) + k, f"{letters.upper() if k % 3 else letters} 12{letters}") for k in range(count // 2)]
            at = dice.randrange(len(letters))
            letters = letters[:at] + dice.choice(["", "x", "é", letters[at] * 2]) + letters[at + 1 :]
            count //= 11
    return rows


def test_variants_equal_the_plain_version(spark):
    rows = texts()
    want = plain_variants(rows)
    assert any(w[1] != (w[0] or "") and w[0] for w in want.values())  # chains of two steps
    assert made(spark, rows) == want


def test_split_units_give_the_same(spark):
    rows = texts()
    want = plain_variants(rows)
    assert made(spark, rows, unit_words=5, most_words=3) == want
    assert made(spark, rows, unit_words=20, most_words=7) == want


def test_hard_rows(spark):
    rows = [(r[0], r[1]) for r in brute.ROWS]
    rows += [(None, "nullident nullident"), (None, None), (9, ""), (9, "repeated repeated"), (9, "repeated repeated")]
    rows += [(70, "Á́×÷ÿÿÿÿÿÿ ÿÿÿÿÿÿ abcdefg-abcdefg ABCDEFG日abcdefg\xad")] * 3
    rows += [(80 + i, "z" * 30_000) for i in range(2)] + [(90, ("lengthyword " * 500_000))]
    assert made(spark, rows) == plain_variants(rows)


def test_empty_table(spark):
    assert made(spark, []) == {}
    assert made(spark, [(1, None), (2, "short")]) == {}


def test_all_documents_of_a_small_folder(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}
    assert got == plain_variants(rows)


@pytest.mark.parametrize("alphabet,size", [("ab", 300), ("abcdeé", 2000), ("abcdefghijklmnopqrstuvwxyz", 1500)])
def test_index_finds_every_word_one_error_away(alphabet, size):
    dice = random.Random(size)
    seeds = ["".join(dice.choice(alphabet) for _ in range(dice.randint(7, 10))) for _ in range(size // 2)]
    seeds += [dice.choice(sorted(edits(w, alphabet))) for w in seeds]
    words = sorted({w for w in seeds if len(w) >= 7})
    place = {w: i for i, w in enumerate(words)}
    want = {(i, place[x]) for i, w in enumerate(words) for x in edits(w, alphabet) & place.keys()}
    index = TwoWayIndex(words)
    left, right = (set(zip(*map(np.ndarray.tolist, f(words)))) for f in (index.by_left_half, index.by_right_half))
    assert not left & right
    assert left | right == want
    # Patterns with letters that no word has.
    who, _ = index.by_left_half(["zzzzzzzé", "ÿÿÿÿÿÿÿ"]) if "z" not in alphabet else ([], None)
    assert len(who) == 0


def test_text_is_cut_between_runs(monkeypatch, spark):
    monkeypatch.setattr(spelling, "_PIECE", 64)
    rows = [(i, " ".join(["wordnumber", "éééééééé", "x" * 200, "日本"] * 9)) for i in range(4)]
    import pyarrow as pa

    column = pa.array([t.encode() for _, t in rows], pa.binary())
    found = Counter()
    for data, bounds, names in spelling._pieces(column, [str(i) for i, _ in rows]):
        for r in spelling._count_piece(data, bounds, names, 7).to_pylist():
            found[r["word"]] += r["n"]
    assert {w: n for w, n in found.items() if n >= 2} == plain_counts(rows)
