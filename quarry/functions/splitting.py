"""Section-aware chunk spans of one text. Everything works on half-open spans into the normalised text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from quarry.functions.text import BOILERPLATE, BULLET, HEADING_CHARS, HEADING_WORDS, SENTENCE_END, WEB, min_chunk_chars

Span = tuple[int, int]

# Where long text may be cut, best first, and the name of the strategy.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
STRATEGY = "section_recursive_v3"
NAVIGATION, NAVIGATION_LINES = "next steps", 6

_NOT_HEADING = [re.compile(p) for p in (BULLET, WEB, BOILERPLATE)]
_SENTENCE = re.compile(SENTENCE_END)


def normalise(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n").strip()


def trimmed(text: str, span: Span) -> Span:
    inside = text[span[0] : span[1]]
    start = span[0] + len(inside) - len(inside.lstrip())
    return start, max(start, span[0] + len(inside.rstrip()))


def lines_of(text: str) -> list[Span]:
    """Trimmed spans of the lines that aren't blank."""
    out, at = [], 0
    for raw in text.splitlines(keepends=True):
        if raw.strip():
            out.append(trimmed(text, (at, at + len(raw))))
        at += len(raw)
    return out


def is_heading(line: str) -> bool:
    s = line.strip()
    if not s or len(s) > HEADING_CHARS or len(s.split()) > HEADING_WORDS or not s[0].isalnum():
        return False
    return not any(p.match(s) for p in _NOT_HEADING) and not _SENTENCE.search(s) and any(map(str.isalpha, s))


def _folded(line: str) -> str:
    return " ".join(line.split()).casefold()


def navigation(text: str, lines: list[Span], title: str) -> Span:
    """Bounds (inclusive starts) of a link list under the page's title, whose lines are no headings."""
    none = (1, 0)
    name = _folded(title)
    if not lines or not name or not (_folded(text[slice(*lines[0])]) + " ").startswith(name + " "):
        return none
    first = next((i for i, x in enumerate(lines[:NAVIGATION_LINES]) if _folded(text[slice(*x)]) == NAVIGATION), None)
    if first is None:
        return none
    gaps = (a[1] for a, b in zip(lines[first:], lines[first + 1 :]) if text.count("\n", a[1], b[0]) > 1)
    return lines[first][0], next(gaps, lines[-1][1])


def sections(text: str, title: str) -> list[tuple[str, Span]]:
    """(title, span): what precedes the first heading under the page's title, then one for each heading."""
    lines = lines_of(text)
    low, high = navigation(text, lines, title)
    heads = [x for x in lines if not low <= x[0] <= high and is_heading(text[slice(*x)])]
    begins = [(title, 0)] * (not heads or heads[0][0] > 0) + [(text[slice(*h)], h[0]) for h in heads]
    ends = [b for _, b in begins[1:]] + [len(text)]
    spans = [(name, trimmed(text, (a, b))) for (name, a), b in zip(begins, ends)]
    return [(name, s) for name, s in spans if s[0] < s[1]]


def grouped(text: str, spans: list[Span], size: int) -> list[Span]:
    """Neighbouring sections joined: a group closes once it reaches size, or before it would grow over
    size if it isn't small."""
    least, out, now = min_chunk_chars(size), [], None
    for span in spans:
        grown = span if now is None else trimmed(text, (now[0], span[1]))
        if now is not None and now[1] - now[0] >= least and grown[1] - grown[0] > size:
            out.append(now)
            grown = span
        now = grown
        if now[1] - now[0] >= size:
            out.append(now)
            now = None
    return out + [now] * (now is not None)


def pieces(text: str, separator: str) -> list[str]:
    """Cut before every separator; each character by itself for none."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def packed(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Runs of pieces up to size; each run begins with the last pieces of the one before, up to overlap."""
    run: list[str] = []
    held = 0
    for p in [*parts, None]:
        if p is None or held + len(p) > size:
            if run and (whole := "".join(run).strip()):
                yield whole
            while p is not None and run and (held > overlap or held + len(p) > size):
                held -= len(run.pop(0))
        if p is not None:
            run.append(p)
            held += len(p)


def recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Chunks of a text by the first separator that occurs; pieces of size or more by the next ones."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    rest = separators[at + 1 :] if separators[at] else ()
    small: list[str] = []
    for p in pieces(text, separators[at]):
        if len(p) < size:
            small.append(p)
            continue
        yield from packed(small, size, overlap)
        small = []
        if rest:
            yield from recursive(p, size, overlap, rest)
        else:
            yield p
    yield from packed(small, size, overlap)


def located(text: str, group: Span, size: int, overlap: int) -> Iterator[Span]:
    """Spans of a group's chunks in the text: searched from where a chunk should begin, else from the top."""
    own, at, before = text[group[0] : group[1]], 0, 0
    for chunk in recursive(own, size, overlap):
        at = own.find(chunk, max(0, at + before - overlap))
        before, hint = len(chunk), group[0] + at
        snippet = chunk.strip()
        found = next((f for f in (text.find(snippet, hint), text.find(snippet)) if f >= 0), hint)
        yield found, found + len(snippet)


def coalesced(text: str, spans: list[Span], size: int, overlap: int) -> list[Span]:
    """Small chunks joined to the next one, or else to the one before, while that stays under size and overlap."""
    if len(spans) < 2:
        return spans
    least, most = min_chunk_chars(size), size + max(overlap, 0)
    cover = lambda a, b: trimmed(text, (min(a[0], b[0]), max(a[1], b[1])))
    fits = lambda s: s[1] - s[0] <= most
    out, waiting = [], list(reversed(spans))
    while waiting:
        now = waiting.pop()
        if now[1] - now[0] < least:
            if waiting and fits(both := cover(now, waiting[-1])):
                waiting[-1] = both
                continue
            if out and fits(both := cover(out[-1], now)):
                out[-1] = both
                continue
        out.append(now)
    return out


def section_of(found: list[tuple[str, Span]], span: Span) -> int:
    """The section with the largest overlap, the first of equals; else the last that begins before; else the first."""
    shared = [min(span[1], b) - max(span[0], a) for _, (a, b) in found]
    if max(shared) > 0:
        return shared.index(max(shared))
    return max((i for i, (_, (a, _)) in enumerate(found) if a <= span[0]), default=0)


def chunks(text: str | None, title: str | None, size: int = 1000, overlap: int = 150) -> list[dict]:
    """index, start, end, text, section_index, section_title of every chunk of a document."""
    if overlap > size:
        raise ValueError("overlap must not exceed size")
    body = normalise(text or "")
    found = sections(body, title or "Untitled")
    groups = grouped(body, [s for _, s in found], size)
    spans = coalesced(body, reduce(lambda out, g: out + list(located(body, g, size, overlap)), groups, []), size, overlap)
    owner = [section_of(found, s) for s in spans]
    return [{"chunk_index": i, "start": a, "end": b, "text": body[a:b], "section_index": k, "section_title": found[k][0]} for i, ((a, b), k) in enumerate(zip(spans, owner))]
