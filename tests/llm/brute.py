"""Plain single-machine versions of the text operators, and a small table of hard cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

UPPER = {c: chr(c + 32) for c in range(65, 91)}
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
LONG = " ".join(f"w{i % 977}x{i % 89}" for i in range(20_000))
BASE = " ".join(f"word{i}" for i in range(120))
COMMON = "This line is long enough to be seen as a repeated line of text."

#: (doc_id, text, lang, source): nulls, empty and long texts, copies, near copies, ties, shared lines.
ROWS = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "   \t\r\n ", "en", "a"),
    (4, "one two", "en", "a"),
    (5, "ONE  two", "en", None),
    (6, "one\ttwo ", None, "a"),
    (7, BASE, "en", "a"),
    (8, BASE, "en", "a"),
    (9, BASE + " tail", "en", "b"),
    (10, BASE.replace("word60", "other"), "en", "b"),
    (11, " ".join(f"word{i}" for i in range(0, 120, 2)), "en", "b"),
    (12, LONG, "de", "c"),
    (13, LONG + " end", "de", "c"),
    (14, "Straße ÉCOLE école 日本語 \x00 😀 naïve", "fr", "c"),
    (15, PASSAGE, "en", "a"),
    (16, f"before {PASSAGE.upper()}, and after {PASSAGE}", "en", "a"),
    (17, "beta gamma delta", "en", "a"),
    (18, "12345 ... !!!", "en", "a"),
    *[(20 + i, f"start {i}\n{COMMON}\n  {COMMON.upper()}\t\nend {i}", "en", "s") for i in range(6)],
    *[(30 + i, f"{COMMON[:39]}\n{i}", "en", "s") for i in range(6)],
    *[(40 + i, "é" * 39 + ("é" if i % 2 else "") + f"\n{i}", "fr", "s") for i in range(12)],
    (60, 'password = "hunter2hunter2"\nAKIA' + "Z" * 16 + "\n" + "0af" * 9, "en", "a"),
    (61, 'seed = "Qk39fjalskdjf93"\nlogin_pwd = seed\n<apiKey>9f8e7d6c5b4a</apiKey>', "en", "a"),
    (62, "<|endoftext|>a<|endoftext|> I'll  go\n\n now", "en", "a"),
]
ITEMS = [(1, PASSAGE), (2, "Beta, GAMMA delta"), (3, None), (4, ""), (5, PASSAGE), (6, "absent words here")]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fold(doc_id, buckets: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % buckets


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def similar(rows, k, percent):
    """doc_id -> (set size, smallest reachable id)."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_token = defaultdict(list)
    for i, s in sets.items():
        for t in s:
            by_token[t].append(i)
    pairs = {(a, b) for ids in by_token.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= percent * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def contaminated(rows, items, size=10):
    wins = defaultdict(set)
    for item, text in items:
        words = benchmark_words(text)
        for s in range(max(1, len(words) - size + 1) if words else 0):
            wins[tuple(words[s : s + size])].add(str(item))
    out = {}
    for doc, text in rows:
        words = benchmark_words(text)
        hit, found = set(), set()
        for s in range(len(words)):
            for win, ids in wins.items():
                if tuple(words[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found |= ids
        out[doc] = (len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def lines(rows, chars=40, docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(doc)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= docs}
    out = {}
    for doc, text in rows:
        parts = (text or "").split("\n")
        kept = [p for p in parts if gone.get(key(p), doc) == doc]
        out[doc] = (len(parts), len(parts) - len(kept), sha("\n".join(kept)))
    return out


def language(profiles, text, top, grams, place):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    counts = Counter(g for w in words for g in grams(w))
    if not counts:
        return "und", 0.0
    own = sorted(counts, key=lambda g: (-counts[g], place(g)))[:top]
    apart = {
        lang: sum(abs(r - ranks[g]) if g in ranks else top for r, g in enumerate(own))
        for lang, ranks in ((x, {g: r for r, g in enumerate(p)}) for x, p in profiles.items())
    }
    best = min(sorted(apart), key=apart.get)
    return best, 1 - apart[best] / (top * len(own))
