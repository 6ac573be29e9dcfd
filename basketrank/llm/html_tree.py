"""Raw HTML to a small tree of labelled elements and texts.

An element is ``[label, children]`` and a text a string with its character
references decoded. Labels are tag names, followed by ``!`` and a role when the
tag, class, id or role attribute tells one, so there are few of them. Missing end
tags are supplied as browsers do for paragraphs, list items and table cells. Elements
nest as deep as the page has them.
"""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(
    r"""<!--(?:.*?--!?>|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*+(?:>|\Z)
        |<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^"'<>]++|"[^"]*"|'[^']*')*+)>
        |<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^<>]*+)>""",
    re.X | re.S,
)
_ATTR = re.compile(r"""(?P<name>[^\s=/"'<>]+)(?:\s*=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)'|(?P<c>[^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not text of the page.
RAW = frozenset("script style noscript template iframe textarea select title svg math object canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Start tags that end an open element of these kinds.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
#: An implied end does not reach beyond these.
WALLS = frozenset("article aside blockquote body div footer form header html main nav ol section table td th ul dl".split())

BOILERPLATE_TAGS = frozenset("nav footer aside form button dialog menu head".split())
# Words of class, id and role attributes and the role they give.
ROLES = {
    "comment": "comments comment disqus respond replies reply commentlist".split(),
    "ad": "ad ads advert adverts advertisement advertising adslot adsense sponsor sponsored promo banner".split(),
    "furniture": (
        "nav navigation navbar menu breadcrumb breadcrumbs pagination pager sidebar aside widget widgets related "
        "recommended share sharing social newsletter subscribe signup login popup modal cookie cookies consent gdpr "
        "notice notices alert toolbar masthead topbar footer header complementary contentinfo search skip"
    ).split(),
    "content": "article articlebody content main entry post story maincontent".split(),
}
_ROLE_OF = {word: role for role in ("content", "furniture", "ad", "comment") for word in ROLES[role]}


def _role(tag: str, attrs: str) -> str:
    """Role of an element from its attributes; what hides it or sets it apart comes first."""
    found = set()
    for m in _ATTR.finditer(attrs):
        name = m["name"].lower()
        value = m["a"] or m["b"] or m["c"] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "furniture"
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return "furniture"
        if name in ("class", "id", "role", "itemprop"):
            found.update(_ROLE_OF[w] for x in _WORD.findall(value) if (w := x.lower()) in _ROLE_OF)
    for role in ("comment", "ad", "furniture", "content"):
        if role in found:
            return role
    return ""


def label_of(tag: str, attrs: str) -> str:
    role = _role(tag, attrs) if attrs.strip() else ""
    if role == "furniture" and tag in ("h1", "h2", "p", "body", "html"):
        role = ""
    return f"{tag}!{role}" if role else tag


def parse(page: str) -> list:
    """The root element of a page, labelled ``/``."""
    root = ["/", []]
    stack, tags = [root], ["/"]
    # Depths of the open elements of a tag, outermost first.
    opened: dict[str, list[int]] = {}
    at, labels = 0, {}

    def text(end: int) -> None:
        if at < end:
            piece = page[at:end]
            if not piece.isspace():
                piece = html.unescape(piece) if "&" in piece else piece
            children = stack[-1][1]
            if children and isinstance(children[-1], str):
                children[-1] += piece
            else:
                children.append(piece)

    def close(wanted: set[str], walls: frozenset) -> None:
        depth = 0
        for tag in wanted:
            if (found := opened.get(tag)) and found[-1] > depth:
                depth = found[-1]
        if not depth:
            return
        for tag in walls:
            if (found := opened.get(tag)) and found[-1] > depth:
                return
        for tag in tags[depth:]:
            opened[tag].pop()
        del stack[depth:], tags[depth:]

    search = _TOKEN.search
    while m := search(page, at):
        text(m.start())
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            close({tag}, frozenset())
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in RAW:
            if not attrs.endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            close({"p"}, WALLS)
        if tag in CLOSES:
            close(CLOSES[tag], WALLS - CLOSES[tag])
        key = (tag, attrs)
        label = labels.get(key) or labels.setdefault(key, label_of(tag, attrs))
        node = [label, []]
        stack[-1][1].append(node)
        if tag not in VOID and not attrs.endswith("/"):
            opened.setdefault(tag, []).append(len(stack))
            stack.append(node)
            tags.append(tag)
    text(len(page))
    return root
