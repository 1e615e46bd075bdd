"""Text of HTML pages: what is visible, and what an embedded page-data script holds.

Built on the standard library's tolerant parser. Malformed markup is recovered simply: an end tag
closes the nearest open element of its name, or is ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without visible text, the data script, and its keys that hold content.
DROPPED = ("nav", "footer", "script", "style", "header", "aside")
NEVER_TEXT = ("script", "style", "template", "rt", "rp")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
DATA_SCRIPT = re.compile(r'<script[^>]*id="__NEXT_DATA__"[^>]*>(.+?)</script>', re.DOTALL)
CONTENT_KEYS = ("bodyContentVal", "pageDescrition", "metaDescription", "descVal")


class _Strings(HTMLParser):
    """Collects text nodes outside the given elements."""

    def __init__(self, without: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.without, self.open, self.out = frozenset(without), [], []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data):
        if self.without.isdisjoint(self.open):
            self.out.append(data)


def text_lines(html: str, without: tuple[str, ...]) -> list[str]:
    """Trimmed non-blank lines of all text nodes, each node on lines of its own."""
    parser = _Strings(without)
    parser.feed(html)
    parser.close()
    return [s for line in "\n".join(parser.out).splitlines() if (s := line.strip())]


def folded(line: str) -> str:
    return " ".join(line.split()).casefold()


def visible_text(html: str) -> str:
    lines = text_lines(html, DROPPED + NEVER_TEXT)
    if len(lines) > 1 and folded(lines[0]) == folded(lines[1]):
        del lines[1]
    return "\n".join(lines)


def content_strings(node) -> Iterator[str]:
    """Strings under content keys of a JSON tree, in document order; what is below them too."""
    if isinstance(node, dict):
        for key, value in node.items():
            if key in CONTENT_KEYS:
                own = value.get("value") if isinstance(value, dict) else value
                if isinstance(own, str):
                    yield own
            yield from content_strings(value)
    elif isinstance(node, list):
        for value in node:
            yield from content_strings(value)


def data_text(html: str) -> str:
    """Content of the embedded data script, equal strings once, as paragraphs; nothing if it isn't JSON."""
    found = DATA_SCRIPT.search(html)
    try:
        tree = json.loads(found[1]) if found else None
    except json.JSONDecodeError:
        return ""
    clean = ("\n".join(text_lines(s, NEVER_TEXT)) if "<" in s else s.strip() for s in content_strings(tree))
    return "\n\n".join(dict.fromkeys(filter(None, clean)))


def overlap(a: list[str], b: list[str]) -> int:
    """How many lines at most end a and begin b, in linear time: for each line of b then of a, the longest
    beginning of b that ends there."""
    if not a or not b:
        return 0
    fall, n = [0], 0
    for line in b[1:]:
        while n and line != b[n]:
            n = fall[n - 1]
        n += line == b[n]
        fall.append(n)
    n = 0
    for line in a[-len(b) :]:
        while n and line != b[n]:
            n = fall[n - 1]
        n += line == b[n]
    return n


def joined(left: str, right: str) -> str:
    """Both texts as paragraphs; lines that end the left and begin the right stand once."""
    if not left or not right:
        return left or right
    a = [folded(x) for x in left.splitlines() if x.strip()]
    lines = right.splitlines(keepends=True)
    full = [i for i, x in enumerate(lines) if x.strip()]
    b = [folded(lines[i]) for i in full]
    same = overlap(a, b)
    rest = "".join(lines[full[same - 1] + 1 :] if same else lines).lstrip()
    return f"{left.rstrip()}\n\n{rest}" if rest else left.rstrip()


def clean_html(html: str | None) -> str:
    return joined(visible_text(html), data_text(html)) if html else ""


def clean_html_column(html: Column) -> Column:
    """clean_html over a column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(clean_html)

    return run(html)
