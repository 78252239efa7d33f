"""A tag scanner for hand-written markup: tags in order, elements by nesting, bold labels and what follows them."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

from .text import collapse, strip_tags

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)([^>]*)>")
#: Texts whose tags are kept: the parts of a page are gone through again and again.
_KEPT = 32


class Tag(NamedTuple):
    name: str
    closing: bool
    start: int
    end: int
    rest: str


def tags(text: str, start: int = 0, end: int | None = None) -> Iterator[Tag]:
    """Tags that lie between ``start`` and ``end``; a tag goes to the first ``>``."""
    every, begins = _every(text)
    if start == 0 and end is None:
        return iter(every)
    first = bisect_left(begins, start)
    if first and every[first - 1].end > start:
        # It begins inside a tag, so what follows may read otherwise.
        return _scan(text, start, len(text) if end is None else end)
    last = len(every) if end is None else bisect_left(begins, end)
    # Where the last tag goes beyond the end, no tag ends between its begin and there.
    return islice(every, first, last - (last > first and end is not None and every[last - 1].end > end))


def _scan(text: str, start: int, end: int) -> Iterator[Tag]:
    for m in _TAG.finditer(text, start, end):
        yield Tag(m[2].lower(), bool(m[1]), m.start(), m.end(), m[3])


@lru_cache(_KEPT)
def _every(text: str) -> tuple[tuple[Tag, ...], tuple[int, ...]]:
    """All tags of a text, and where they begin."""
    found = tuple(_scan(text, 0, len(text)))
    return found, tuple(t.start for t in found)


def close_of(text: str, tag: Tag, end: int) -> Tag | None:
    """The tag that closes ``tag``, counting those of its name in between."""
    depth = 1
    for t in tags(text, tag.end, end):
        if t.name == tag.name:
            depth += -1 if t.closing else 1
            if not depth:
                return t
    return None


def blank(text: str, start: int, end: int) -> bool:
    return not text[start:end].strip()


def swallow(text: str, at: int, end: int, closers: set[str]) -> tuple[int, list[str]]:
    """Where a run of white space, line breaks and closing tags of ``closers`` ends, and the names of the closing tags."""
    names = []
    for t in tags(text, at, end):
        if not blank(text, at, t.start) or not (t.name == "br" or t.closing and t.name in closers):
            break
        at = t.end
        if t.closing:
            names.append(t.name)
    while at < end and text[at].isspace():
        at += 1
    return at, names


@dataclass(frozen=True)
class Label:
    """A bold text without tags inside, and where it and its value begin; a colon after the tag belongs to the label."""

    text: str
    start: int
    value: int


def labels(markup: str, longest: int) -> list[Label]:
    out, bold = [], None
    for t in tags(markup):
        if t.name == "b" and t.closing and bold is not None:
            inner = markup[bold.end : t.start].strip()
            inner = inner.removesuffix(":").rstrip()
            if 1 <= len(inner) <= longest:
                value = t.end
                while value < len(markup) and markup[value].isspace():
                    value += 1
                value = value + 1 if markup[value : value + 1] == ":" else t.end
                out.append(Label(collapse(strip_tags(inner)), bold.start, value))
        bold = t if t.name == "b" and not t.closing else None
    return out


def values(markup: str, found: list[Label]) -> list[str]:
    """The markup after each label up to the next."""
    ends = [*[x.start for x in found], len(markup)][1:]
    return [markup[x.value : end] for x, end in zip(found, ends, strict=True)]
