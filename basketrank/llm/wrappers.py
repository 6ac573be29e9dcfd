"""Main text of pages by wrappers, union-free regular expressions learned per host.

A wrapper describes the token stream of all pages of a host: tags, constant texts,
text slots, optional groups and repeated groups. It starts as the stream of one
page and is aligned with page after page:

* a text that differs becomes a slot,
* equal neighbours, alone or in groups of up to ``GROUP``, become a repeated group,
* what only one side has becomes an optional group.

Tags are balanced first (``html_tree``), so the expression is kept as nested
elements, written as JSON with one item after another. Elements may nest to any
depth: steps over them run on a stack of their own. Every task folds its pages into one wrapper per host; wrappers
are then aligned with each other like pages, in two steps, each streaming over
sorted rows, so a host with a third of all pages stays small everywhere. The work
covers all pages. A wrapper keeps the order of its items at any length: it grows with
the longest page of a host and the number of labels, not with the number of pages.

A page is read by walking it along its host's wrapper. The wrapper names the
region of the article: ``article`` elements, else ``main`` or content elements, else the
element down to which most slot text lies. Inside, furniture (menus, forms,
adverts, comments and the like) is left out, and in regions without such a
label also blocks whose texts are constant over the host and blocks of links.

Defined results: null or empty pages, and pages without main text, have an empty
text; null addresses share one host; null and repeated ids stay as they are, row
by row; other columns are not read.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Generator, Iterator
from math import isqrt

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from basketrank.functions.joins import BROADCAST_BYTES, lookup
from basketrank.functions.staging import stage
from basketrank.llm.common import keeps, named
from basketrank.llm.html_tree import BOILERPLATE_TAGS, INLINE, VOID, parse

#: Longest group of neighbours that is looked for as a repetition.
GROUP = 4
#: Hosts that a task folds at a time, and characters of their first pages.
HOSTS = 2000
HOST_CHARS = 1 << 25
#: Characters of the wrappers whose readers a task keeps.
READER_CHARS = 1 << 22
#: Code points above which a wrapper holds a digest of a constant text.
LONG_TEXT = 64
#: Share of the slot text that the region without a label must hold.
REGION_SHARE = 0.6

# A wrapper item is [label, kind, text, chars, links, items]: kind "1" once, "?"
# optional, "+" repeated; label "#" is text, whose text is a constant or None for a
# slot; chars and links count the characters of the texts below, links those in <a>.
LABEL, KIND, TEXT, CHARS, LINKS, ITEMS = range(6)


def squeeze(text: str) -> str:
    return " ".join(text.split())


def _constant(text: str) -> str:
    """A text, or a digest of a long one: constants are only compared."""
    return text if len(text) <= LONG_TEXT else f"~{len(text)}~{xxhash.xxh3_128_hexdigest(text.encode())}"


def unroll(call: Generator):
    """The result of a generator that yields its recursive calls, at any depth."""
    calls, value = [call], None
    while calls:
        try:
            call = calls[-1].send(value)
        except StopIteration as done:
            calls.pop()
            value = done.value
        else:
            calls.append(call)
            value = None
    return value


def wrap(node: list) -> list:
    """The wrapper of one element of one page."""
    return unroll(_wrap(node, False))


def _wrap(node: list, linked: bool) -> Generator:
    linked = linked or node[0].split("!")[0] == "a"
    items = []
    for child in node[1]:
        if isinstance(child, str):
            text = squeeze(child)
            if text:
                items.append(["#", "1", _constant(text), len(text), len(text) if linked else 0, []])
        else:
            items.append((yield _wrap(child, linked)))
    return _node(node[0], "1", (yield _fold(items)) if len(items) > 1 else items)


def _node(label: str, kind: str, items: list) -> list:
    return [label, kind, None, sum(i[CHARS] for i in items), sum(i[LINKS] for i in items), items]


def _fold(items: list) -> Generator:
    """Neighbouring repetitions as repeated groups, short groups first."""
    for size in range(1, GROUP + 1):
        if len(items) < 2 * size:
            break
        labels = [i[LABEL] for i in items]
        out, at = [], 0
        while at < len(items):
            again = at + size
            if size > 1 and len(set(labels[at:again])) == 1:
                again = len(items) + 1
            while labels[at : at + size] == labels[again : again + size] and len(labels[again : again + size]) == size:
                for k in range(size):
                    items[at + k] = yield _align(items[at + k], items[again + k])
                again += size
            if again <= len(items) and again > at + size:
                for k in range(size):
                    items[at + k][KIND] = "+"
                out += items[at : at + size]
                at = again
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def align(a: list, b: list) -> list:
    """The wrapper of what ``a`` and ``b``, of one label, describe."""
    return unroll(_align(a, b))


def _align(a: list, b: list) -> Generator:
    kind = "+" if "+" in (a[KIND], b[KIND]) else "?" if "?" in (a[KIND], b[KIND]) else "1"
    if a[LABEL] == "#":
        text = a[TEXT] if a[TEXT] == b[TEXT] else None
        return ["#", kind, text, a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], []]
    items = yield _align_items(a[ITEMS], b[ITEMS])
    if [i[LABEL] for i in items] != [i[LABEL] for i in a[ITEMS]]:
        items = yield _fold(items)
    return _node(a[LABEL], kind, items)


def _earlier(a: list[str], b: list[str]):
    """Whether ``a[i]`` comes before ``b[j]`` when a longest common subsequence is kept, for rising i.

    That is when ``a[i + 1:]`` and ``b[j:]`` have one as long as ``a[i:]`` and
    ``b[j + 1:]``. A row has a bit for each place of ``b``, the last one lowest; its
    zeros among the lowest k are the length for the last k places (Hyyro). Every
    ``step``-th row is kept and those between are made again when they are asked for.
    """
    whole = (1 << len(b)) - 1
    places = dict.fromkeys(a, 0)
    for j, label in enumerate(reversed(b)):
        if label in places:
            places[label] |= 1 << j

    def above(row: int, i: int) -> int:
        hit = row & places[a[i]]
        return (row + hit | row - hit) & whole

    step = isqrt(len(a)) + 1
    row, kept = whole, {len(a): whole}
    for i in range(len(a) - 1, -1, -1):
        row = above(row, i)
        if i % step == 0:
            kept[i] = row
    rows: dict[int, int] = {}

    def length(i: int, j: int) -> int:
        if i not in rows:
            low = i - i % step
            high = min(low + step, len(a))
            rows.clear()
            rows[high] = kept[high]
            for k in range(high - 1, low - 1, -1):
                rows[k] = above(rows[k + 1], k)
        left = len(b) - j
        return left - (rows[i] & (1 << left) - 1).bit_count()

    def first(i: int, j: int) -> bool:
        after = length(i, j + 1)
        return length(i + 1, j) >= after

    return first


def _align_items(a: list, b: list) -> Generator:
    """Items of both in an order that keeps both orders; unmatched ones are optional."""
    la, lb = [i[LABEL] for i in a], [i[LABEL] for i in b]
    if la == lb:
        out = []
        for x, y in zip(a, b):
            out.append((yield _align(x, y)))
        return out
    first_of_a = _earlier(la, lb)
    out, i, j = [], 0, 0

    def lone(item: list) -> None:
        if item[KIND] == "1":
            item[KIND] = "?"
        out.append(item)

    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and la[i] == lb[j]:
            out.append((yield _align(a[i], b[j])))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and first_of_a(i, j):
            lone(a[i])
            i += 1
        else:
            lone(b[j])
            j += 1
    return out


def _furniture(label: str, inside: bool) -> bool:
    tag, _, role = label.partition("!")
    return role in ("comment", "ad", "furniture") or tag in BOILERPLATE_TAGS or tag == "header" and not inside


def _find(wrapper: list, wanted) -> list[list]:
    """The outermost items that ``wanted`` accepts, outside furniture."""
    out, todo = [], [wrapper]
    while todo:
        for child in todo.pop()[ITEMS]:
            if child[LABEL] != "#" and not _furniture(child[LABEL], False):
                (out if wanted(child) else todo).append(child)
    return out


def _inner_first(wrapper: list) -> Iterator[list]:
    """All items, every one after those below it."""
    order = [wrapper]
    for item in order:
        order += item[ITEMS]
    return reversed(order)


def _plain(wrapper: list) -> dict[int, int]:
    """Characters of slots outside links and furniture, by the id of an item."""
    out: dict[int, int] = {}
    for item in _inner_first(wrapper):
        if item[LABEL] == "#":
            out[id(item)] = item[CHARS] - item[LINKS] if item[TEXT] is None else 0
        else:
            out[id(item)] = sum(
                out[id(i)] for i in item[ITEMS] if i[LABEL] == "#" or not _furniture(i[LABEL], False)
            )
    return out


def regions(wrapper: list, plain: dict[int, int]) -> tuple[bool, list[list]]:
    """Whether the article region carries a label, and the region's elements."""
    for wanted in (
        lambda i: i[LABEL].split("!")[0] == "article" and i[CHARS],
        lambda i: i[LABEL].split("!")[0] == "main" and i[CHARS],
        lambda i: i[LABEL].endswith("!content") and i[CHARS],
    ):
        if found := _find(wrapper, wanted):
            return True, found
    item = wrapper
    while True:
        total = plain[id(item)]
        inner = [
            (plain[id(c)], i) for i, c in enumerate(item[ITEMS]) if c[LABEL] != "#" and not _furniture(c[LABEL], False)
        ]
        most, at = max(inner, default=(0, 0))
        child = item[ITEMS][at] if inner else None
        if not most or most < REGION_SHARE * total or child[KIND] == "+" or child[LABEL] in ("p", "br"):
            return False, [item]
        item = child


def _slots(wrapper: list) -> set[int]:
    """Ids of the items in which any text differs between pages."""
    out: set[int] = set()
    for item in _inner_first(wrapper):
        if item[TEXT] is None if item[LABEL] == "#" else any(id(i) in out for i in item[ITEMS]):
            out.add(id(item))
    return out


def _link_block(item: list) -> bool:
    return item[CHARS] > 0 and 2 * item[LINKS] > item[CHARS]


class Reader:
    """Reads pages along one wrapper."""

    def __init__(self, wrapper: list):
        self.wrapper = wrapper
        plain = _plain(wrapper)
        self.labelled, found = regions(wrapper, plain)
        self.regions = {id(item) for item in found}
        self.has_slots = plain[id(wrapper)] > 0
        self.slots = set() if self.labelled else _slots(wrapper)
        self.places: dict[int, dict[str, list[int]]] = {}

    def text(self, page: list) -> str:
        self.blocks: list[str] = []
        self.open = ""
        self.reached = id(self.wrapper) in self.regions
        unroll(self._walk(page, self.wrapper, self.reached))
        self._end()
        return " ".join(self.blocks)

    def _end(self) -> None:
        if block := squeeze(self.open):
            self.blocks.append(block)
        self.open = ""

    def _places(self, item: list) -> dict[str, list[int]]:
        """Where the items below have a label."""
        if (found := self.places.get(id(item))) is None:
            found = self.places[id(item)] = {}
            for k, below in enumerate(item[ITEMS]):
                found.setdefault(below[LABEL], []).append(k)
        return found

    def _walk(self, node: list, item: list | None, inside: bool) -> Generator:
        """Collect the texts of ``node``, described by ``item`` of the wrapper."""
        items = item[ITEMS] if item else []
        places = self._places(item) if items else {}
        at = 0
        for child in node[1]:
            label = "#" if isinstance(child, str) else child[0]
            if label == "#" and not child.strip():
                if inside:
                    self.open += " "
                continue
            # The next item with this label; a repeated one may serve again.
            found = None
            if own := places.get(label):
                k = bisect_left(own, at)
                found = own[min(k, len(own) - 1)]
                if k < len(own):
                    at = found if items[found][KIND] == "+" else found + 1
            known = None if found is None else items[found]
            if label == "#":
                if inside:
                    self.open += child
                continue
            tag = label.split("!")[0]
            within = inside or known is not None and id(known) in self.regions
            self.reached |= within
            if _furniture(label, within and self.labelled):
                self._end()
                continue
            if within and not self.labelled and known is not None and tag not in INLINE:
                fixed = self.has_slots and known[KIND] != "+" and known[CHARS] and id(known) not in self.slots
                if fixed or _link_block(known):
                    self._end()
                    continue
            inline = tag in INLINE
            if not inline:
                self._end()
            if tag not in VOID:
                yield self._walk(child, known, within)
            if not inline:
                self._end()


_READERS: dict[str, Reader] = {}
keeps("wrappers", _READERS.clear)


def reader(wrapper: str) -> Reader:
    """The reader of a wrapper; all kept ones go when they become too many."""
    found = _READERS.get(wrapper)
    if found is None:
        if len(wrapper) + sum(map(len, _READERS)) > READER_CHARS:
            _READERS.clear()
        found = _READERS[wrapper] = Reader(_load(wrapper))
    return found


def main_text(page: str | None, wrapper: str) -> str:
    """Text of the article of ``page``, read along ``wrapper``.

    A page without the region that its host's other pages have is read along the
    wrapper of its own.
    """
    if not page:
        return ""
    tree, along = parse(page), reader(wrapper)
    text = along.text(tree)
    return text if along.reached else Reader(wrap(tree)).text(tree)


def host_of(url):
    host = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(host, r"^.*@|:\d*$", "")


def _dump(wrapper: list) -> str:
    """JSON list of the fields of all items, outer ones first, the last field the number of items below."""
    out, todo = [], [wrapper]
    while todo:
        item = todo.pop()
        out += [*item[:ITEMS], len(item[ITEMS])]
        todo += reversed(item[ITEMS])
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def _load(text: str) -> list:
    fields, done = json.loads(text), []
    width = ITEMS + 1
    for at in range(len(fields) - width, -1, -width):
        *own, n = fields[at : at + width]
        items = done[len(done) - n :][::-1]
        del done[len(done) - n :]
        done.append([*own, items])
    return done[0]


def learn_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from (host, html) rows."""

    def from_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        held = 0

        def out() -> pa.RecordBatch:
            rows = [(h, _dump(w)) for h, w in known.items()]
            known.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["host", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = page.as_py()
                if not page:
                    continue
                own = wrap(parse(page))
                old = known.get(host)
                known[host] = align(old, own) if old else own
                held += 0 if old else len(page)
                if len(known) >= HOSTS or held >= HOST_CHARS:
                    held = 0
                    yield out()
        yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, wrapper = None, None
        row = lambda: pa.RecordBatch.from_arrays(
            [pa.array([host], pa.string()), pa.array([_dump(wrapper)], pa.string())], ["host", "wrapper"]
        )
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != host:
                    if host is not None:
                        yield row()
                    host, wrapper = name, _load(text)
                else:
                    wrapper = align(wrapper, _load(text))
        if host is not None:
            yield row()

    kind = "host string, wrapper string"
    per_task = pages.select("host", "html").mapInArrow(from_pages, kind)
    salted = per_task.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(32)))
    # Sorted by wrapper, the result does not depend on which task ends first.
    some = (
        salted.repartition("host", "salt")
        .sortWithinPartitions("host", "salt", "wrapper")
        .select("host", "wrapper")
        .mapInArrow(merge, kind)
    )
    return some.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(merge, kind)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars): the main text of every page."""
    rows = pages.select(
        named(id_col).alias("_id"),
        named(url_col).alias("_url"),
        named(html_col).cast("string").alias("html"),
        host_of(named(url_col)).alias("host"),
    )
    wrappers = stage(learn_wrappers(rows), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(page.as_py(), along) if (along := wrapper.as_py()) else ""
                for page, wrapper in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["_id", "_url", "text", "n_chars"],
            )

    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 64)).first()[0] or 0
    joined = lookup(rows, wrappers, "host", spread="_id", fits=size <= BROADCAST_BYTES).select("_id", "_url", "html", "wrapper")
    kind = T.StructType(
        [rows.schema["_id"], rows.schema["_url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )
    return joined.mapInArrow(run, kind).withColumnsRenamed({"_id": id_col, "_url": url_col})
