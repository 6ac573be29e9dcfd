"""Secrets in texts by assignment-aware lexing, on top of fixed base patterns.

The lexer reads source and configuration syntax (``name = "x"``, ``name: x``,
``"name": "x"``, ``name => x``, ``<name>x</name>``, ``export NAME=x``) into pairs of a
name and the literals of its value. A value may be a literal, a name that was
given a literal before, or a sum of both; names are looked up as they stood at
that place, so constants propagate. Every literal that reaches a target is
scored by how sensitive the target's name is and how much the literal looks
like a secret; from ``THRESHOLD`` on its span is reported as kind ``literal``.

Base spans (``assign``, ``access``, ``hex``) are always kept. A literal inside a base
span of its own text is not reported twice. Spans are in code points, the end
exclusive, ordered by start, then kind as listed, then end.

Defined results: a null or empty text has no spans; null and repeated ids stay
as they are, row by row; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from basketrank.llm.common import named

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "literal")
THRESHOLD = 0.6

# The base patterns and the least lengths of their matches.
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
# A quick look at whole texts: a run of this kind has the least length already.
_LONG_HEX = re.compile(r"[0-9a-f]{24}")

_PAIR = re.compile(
    r"""(?<![\w.$-])(?P<name>[A-Za-z_$][\w.-]*+)(?:\[["']?(?P<key>[\w.-]++)["']?\])?["']?[ \t]*+
        (?:(?P<op>:=|=>|=(?!=)|:(?![:/=]))|(?P<tag>>))[ \t]*+""",
    re.X,
)
_PART = re.compile(
    r"""(?P<quote>["'`])(?P<quoted>(?:[^"'`\\\n]|\\.|(?!(?P=quote))["'`])*+)(?P=quote)
        |\$\{(?P<braced>[A-Za-z_][\w.]*+)\}
        |\$?(?P<name>[A-Za-z_][\w.]*+)(?=[ \t]*+(?:[+;,)\]}\r\n]|$))
        |(?P<bare>[^\s"'`,;<>()\[\]{}]++)""",
    re.X,
)
_SUM = re.compile(r"[ \t]*+(?:\+|\.(?=[ \t]*[\"'`$]))[ \t]*+")
_SUBWORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_FILLER = re.compile(
    r"(?i)(?:x+|\*+|\.+|-+|none|null|nil|true|false|undefined|changeme|example|placeholder|todo|your[\w.-]*|<.*>|\$.*|%.*|\{.*)$"
)

# Sub-words of target names and how sensitive they are, alone or in pairs.
SENSITIVE = {
    "password": 0.6,
    "passwd": 0.6,
    "passphrase": 0.6,
    "pwd": 0.5,
    "pass": 0.4,
    "secret": 0.6,
    "secrets": 0.6,
    "token": 0.55,
    "apikey": 0.6,
    "credential": 0.5,
    "credentials": 0.5,
    "auth": 0.35,
    "signature": 0.35,
    "salt": 0.35,
    "pin": 0.2,
}
SENSITIVE_PAIRS = {
    (a, "key"): 0.6
    for a in ("api", "access", "private", "secret", "signing", "encryption", "auth", "master", "account", "shared")
}


def sensitivity(name: str) -> float:
    words = [w.lower() for w in _SUBWORDS.findall(name)]
    alone = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    return max([alone, *(SENSITIVE_PAIRS.get(p, 0.0) for p in zip(words, words[1:]))])


def strength(literal: str, quoted: bool) -> float:
    """0 for what cannot be a secret, up to 0.5 for long mixed strings."""
    n = len(literal)
    if n < 6 or _FILLER.match(literal) or any(c.isspace() for c in literal):
        return 0.0
    digits = any(c.isdigit() for c in literal)
    letters = any(c.isalpha() for c in literal)
    other = any(not c.isalnum() for c in literal)
    if not quoted and not (digits and letters):
        return 0.0
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    return min(0.5, 0.05 * entropy + 0.1 * (digits and letters) + 0.05 * other + 0.05 * (n >= 12) + 0.05 * quoted)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _LONG_HEX.search(text):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


class _Value:
    """What an assignment gives: literals (start, end) -> quoted of its own, and values given before.

    ``told`` is the most sensitive target that it reaches: (sensitivity, -order, name).
    """

    __slots__ = ("own", "parts", "told")

    def __init__(self):
        self.own: dict[tuple[int, int], bool] = {}
        self.parts: list[_Value] = []
        self.told: tuple[float, int, str] = (0.0, 0, "")


def _value(text: str, at: int, known: dict[str, _Value]) -> tuple[_Value, int]:
    """The value at ``at``, and where it ends."""
    value = _Value()
    while m := _PART.match(text, at):
        at = m.end()
        name = m["braced"] or m["name"]
        if m["quoted"] is not None:
            value.own[m.span("quoted")] = True
        elif name in known:
            value.parts.append(known[name])
        elif not m["braced"]:
            value.own[m.span("name") if name else m.span("bare")] = False
        more = _SUM.match(text, at)
        if not more:
            break
        at = more.end()
    return value, at


def literal_spans(text: str) -> list[tuple[int, int, str, str, float]]:
    """(start, end, "literal", target name, score) of literals given to sensitive names.

    A literal that reaches several targets is scored for the most sensitive of them,
    the first of equals. Values share the values they were made of, and what they
    reach is handed down once, so the time follows the length of the text.
    """
    known: dict[str, _Value] = {}
    values: list[_Value] = []
    at = 0
    while m := _PAIR.search(text, at):
        # a = b = "c" and a: b = "c" give one value to several names.
        names = []
        while m:
            names.append(m["key"] or m["name"])
            last, at = m, m.end()
            m = None if last["tag"] else _PAIR.match(text, at)
        if last["tag"]:
            # <name>value</name>
            if text[last.start() - 1 : last.start()] != "<":
                continue
            close = text.find("<", at)
            if not text.startswith(f"</{last['name']}", close):
                continue
            value = _Value()
            value.own[at, close] = True
            at = close
        else:
            value, at = _value(text, at, known)
        for name in names:
            known[name] = value
        own, name = max((sensitivity(n), n) for n in names)
        value.told = (own, -len(values), name)
        values.append(value)
    found = []
    # A value is made of earlier ones, so the last comes first.
    for value in reversed(values):
        own, _, name = value.told
        if not own:
            continue
        for part in value.parts:
            part.told = max(part.told, value.told)
        for span, quoted in value.own.items():
            strong = strength(text[slice(*span)], quoted)
            score = min(1.0, own + strong) if strong else 0.0
            if score >= THRESHOLD:
                found.append((*span, "literal", name, score))
    return found


def scan(text: str | None) -> list[tuple[int, int, str, str | None, float | None]]:
    """All spans of one text in their order."""
    if not text:
        return []
    base = base_spans(text)
    found = [(s, e, k, None, None) for s, e, k in base]
    if "=" in text or ":" in text or "</" in text:
        # The furthest end of the base spans up to each start.
        starts = sorted((s, e) for s, e, _ in base)
        reach = list(accumulate((e for _, e in starts), max))
        for literal in literal_spans(text):
            before = bisect_right(starts, (literal[0], len(text)))
            if not before or reach[before - 1] < literal[1]:
                found.append(literal)
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): per row an array of (kind, start, end, name, score)."""
    span = pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": s, "end": e, "name": n, "score": x} for s, e, k, n, x in scan(t.as_py())]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], ["_id", "spans"])

    rows = docs.select(named(id_col).alias("_id"), named(text_col).cast("string").alias("_text"))
    parts = T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("name", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    kind = T.StructType([rows.schema["_id"], T.StructField("spans", T.ArrayType(parts))])
    return rows.mapInArrow(run, kind).withColumnRenamed("_id", id_col)
