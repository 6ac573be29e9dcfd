"""Exact and near duplicates, repeated lines, benchmark passages."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from basketrank.llm import components, decontaminate, exact_dedup, line_dedup, ngram_join  # noqa: E402
from basketrank.llm.signature_tree import linked, possible_pairs, signature, similar_pairs  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string"
PLAIN = [(r[0], r[1]) for r in brute.ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns with names that the operators use inside.
    return (
        spark.createDataFrame(brute.ROWS, SCHEMA)
        .repartition(5, "doc_id")
        .selectExpr("*", "'x' AS digest", "1 AS _best", "2 AS _place", "3 AS keys", "4 AS Keep_id", "5 AS _dropped")
    )


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_exact_groups(docs):
    best, size = {}, {}
    for doc, text in PLAIN:
        best[text or ""] = max(doc, best.get(text or "", 0))
        size[text or ""] = size.get(text or "", 0) + 1
    want = {d: (best[t or ""], size[t or ""], best[t or ""] == d, brute.sha(t or "")) for d, t in PLAIN}
    for capacity in (2, 64, 4096):
        got = by_id(
            exact_dedup.duplicate_groups(docs, capacity=capacity), "keep_id", "group_size", "kept", "text_sha256"
        )
        assert got == want


def test_exact_groups_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for capacity in (2, 4096):
        found = exact_dedup.duplicate_groups(df, capacity=capacity).collect()
        assert len(found) == len(rows)
        kept = sorted((r.doc_id or 0, r.group_size) for r in found if r.kept)
        assert kept == [(0, 6), (1, 9), (2, 3)]
        left = exact_dedup.drop_duplicates(df, capacity=capacity).collect()
        assert sorted((r.doc_id or 0, r.text) for r in left) == [(0, "b"), (1, "a"), (2, "c")]


def test_drop_exact_duplicates(docs):
    best = {}
    for doc, text in PLAIN:
        best[text or ""] = max(doc, best.get(text or "", 0))
    for capacity in (2, 4096):
        left = exact_dedup.drop_duplicates(docs, capacity=capacity)
        assert left.columns == docs.columns
        assert sorted(r.doc_id for r in left.collect()) == sorted(best.values())


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (1, 50)])
def test_similarity_components(docs, words, percent):
    want = brute.similar(PLAIN, words, percent)
    got = by_id(ngram_join.similarity_components(docs, words, percent), "n_shingles", "component_id")
    assert got == want


def test_traversal_memory_follows_the_bitmaps():
    """2,600 sets of 200 shingles, unrelated pairs of near copies, one shingle common to all."""
    import tracemalloc

    dice = np.random.default_rng(0)
    sets = []
    for _ in range(1300):
        own = dice.integers(0, 2**62, 200).astype(np.uint64)
        own[0] = 7
        near = own.copy()
        near[5] = dice.integers(0, 2**62)
        sets += [np.unique(own), np.unique(near)]
    tracemalloc.start()
    a, b = similar_pairs(sets, np.arange(len(sets)), 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(a // 2, b // 2)) == [(i, i) for i in range(1300)]
    assert peak < 300e6


@pytest.mark.parametrize("most_bytes", [None, 64, 2000])
@pytest.mark.parametrize("percent", [50, 80])
def test_pairs_and_links_with_narrow_bitmaps(most_bytes, percent):
    dice = np.random.default_rng(percent)
    sets = [np.unique(dice.integers(0, 60, dice.integers(0, 30))).astype(np.uint64) for _ in range(120)]
    sets += [np.unique(np.append(s, dice.integers(0, 60, 2).astype(np.uint64))) for s in sets]
    groups = np.unique(dice.integers(0, 180, len(sets)), return_inverse=True)[1]
    want = set()
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(x, sets[j]))
            if groups[i] != groups[j] and len(x) and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                want.add((j, i))
    a, b = similar_pairs(sets, groups, percent, most_bytes)
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} == want
    root = list(range(groups.max() + 1))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in want:
        x, y = sorted((find(groups[i]), find(groups[j])))
        root[y] = x
    assert linked(sets, groups, percent, most_bytes).tolist() == [find(x) for x in range(len(root))]


def test_shingles_of_the_same_classes_are_looked_at_once(spark):
    rows = [(t, c) for t in (5, 6, 7) for c in (1, 2)] + [(8, 1), (8, 2), (8, 3), (9, 2), (9, 3), (10, 2), (10, 3)]
    df = spark.createDataFrame(rows, "token long, class long")
    kept = {(r.token, r["class"]) for r in ngram_join.one_per_membership(df).collect()}
    assert kept == {(5, 1), (5, 2), (8, 1), (8, 2), (8, 3), (9, 2), (9, 3)}


def test_similarity_in_small_units(spark):
    """Buckets far above the bound of a unit, with links in chains and copies."""
    random = np.random.default_rng(3)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for doc in range(150):
        own = list(base)
        for at in random.integers(0, 60, random.integers(0, 4)):
            own[at] = f"v{random.integers(0, 6)}"
        rows.append((doc, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute.similar(rows, 3, 85)
    assert len({c for _, c in want.values()}) > 1
    for unit in (100, 1000, 1 << 19):
        got = by_id(
            ngram_join.similarity_components(df, 3, 85, unit_tokens=unit, sift_tokens=unit), "n_shingles", "component_id"
        )
        assert got == want


def test_drop_near_duplicates(docs):
    want = brute.similar(PLAIN, 5, 80)
    left = ngram_join.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def test_similarity_with_null_and_repeated_ids(spark):
    rows = [(None, brute.BASE), (3, brute.BASE), (3, brute.BASE), (2, brute.BASE + " x"), (None, "p q r"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.similarity_components(df).collect())
    assert found == [(0, 0), (0, 2), (2, 2), (3, 2), (3, 2), (4, 4)]


def test_signature_tree_equals_all_pairs():
    random = np.random.default_rng(0)
    for trial in range(60):
        m = random.integers(1, 70)
        base = [np.unique(random.integers(0, 1 << 62, random.integers(1, 80)).astype(np.uint64)) for _ in range(5)]
        sets = []
        for _ in range(m):
            b = base[random.integers(5)]
            kept = b[random.random(len(b)) > random.random() * 0.3]
            sets.append(np.unique(np.concatenate([kept, random.integers(0, 1 << 62, random.integers(0, 6)).astype(np.uint64)])))
        groups = random.integers(0, m, m) if trial % 2 else np.arange(m)
        percent = int(random.choice([50, 80, 85]))
        a, b = similar_pairs(sets, groups, percent)
        got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
        want = set()
        for i in range(m):
            for j in range(i):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if groups[i] != groups[j] and shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    want.add((j, i))
        assert got == want
        # Hashed bitmaps may keep more pairs, never fewer.
        sizes = np.array([len(x) for x in sets])
        a, b = possible_pairs([signature(x) for x in sets], sizes, percent)
        every = {tuple(sorted((i, j))) for i in range(m) for j in range(i) if _similar(sets[i], sets[j], percent)}
        assert every <= set(zip(a.tolist(), b.tolist()))


def _similar(x, y, percent):
    shared = len(np.intersect1d(x, y))
    return shared and 100 * shared >= percent * (len(x) + len(y) - shared)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (205, 200)]
    found = components.smallest_reachable(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.root for r in found.collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 205: 200}
    assert got == want


def test_repeated_lines(docs):
    got = by_id(line_dedup.line_report(docs), "n_lines", "n_dropped", "kept_sha256")
    assert got == brute.lines(PLAIN)
    left = line_dedup.drop_lines(docs)
    assert left.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert {r.doc_id: brute.sha(r.text) for r in left.collect()} == {d: v[2] for d, v in got.items()}


def test_repeated_lines_with_a_full_filter(docs, monkeypatch):
    """A filter far too small suspects everything and changes nothing."""
    monkeypatch.setattr(line_dedup, "filter_bits", lambda rows: 1 << 16)
    monkeypatch.setattr(line_dedup, "PROBES", 1)
    assert by_id(line_dedup.line_report(docs), "n_lines", "n_dropped", "kept_sha256") == brute.lines(PLAIN)


def test_repeated_lines_null_and_repeated_ids(spark):
    line = brute.COMMON
    rows = [(None, line), (5, line), (5, line), (1, line), (2, line), (3, line), (4, line + "\n" + line)]
    found = line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id or 0, r.n_lines, r.n_dropped) for r in found)
    assert got == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 2, 2), (5, 1, 0), (5, 1, 0)]


def test_bloom_segments_survive_packing():
    for share in (0.0, 0.001, 0.2, 1.0):
        bits = (np.random.default_rng(1).random(1 << 16) < share).astype(np.uint8)
        part = np.packbits(bits, bitorder="little")
        assert (line_dedup.unpack(line_dedup.pack(part)) == part).all()


def test_benchmark_passages(docs, spark):
    bench = spark.createDataFrame(brute.ITEMS, "item_id long, text string")
    want = brute.contaminated(PLAIN, brute.ITEMS)
    assert any(v[4] for v in want.values())
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for block in (2, decontaminate.BLOCK):
        assert by_id(decontaminate.contamination(docs, bench, block=block), *names) == want
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, v in want.items() if not v[4])


def test_benchmark_vocabulary_too_long_to_broadcast(docs, spark, monkeypatch):
    bench = spark.createDataFrame(brute.ITEMS, "item_id long, text string")
    want = {d: v[1] for d, v in brute.contaminated(PLAIN, brute.ITEMS).items()}
    monkeypatch.setattr(decontaminate, "fits_broadcast", lambda *a, **b: False)
    assert {d: v[0] for d, v in by_id(decontaminate.contamination(docs, bench), "n_hit").items()} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame(brute.ROWS[:5], SCHEMA)
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert exact_dedup.drop_duplicates(none).count() == 0
    assert ngram_join.similarity_components(none).count() == 0
    assert ngram_join.drop_near_duplicates(none).count() == 0
    assert line_dedup.line_report(none).count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(some, bench).collect())
    assert decontaminate.drop_contaminated(some, bench).count() == 5
