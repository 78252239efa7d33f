"""What a page's markup shows besides its fields: the facts that quality checks judge later, as columns."""

from __future__ import annotations

import re
from typing import Any

from . import fixed
from .body import clean
from .markup import close_of, swallow, tags
from .pages import _refers, _tail_links, target_site
from .text import anchors, clip

_MOJIBAKE = re.compile(fixed.MOJIBAKE)
#: Characters on both sides of a find that an excerpt shows.
AROUND = 40


def excerpt(text: str, start: int, end: int) -> dict[str, Any]:
    return {"excerpt": clip(text[max(0, start - AROUND) : end + AROUND]), "char_offset": start}


def _header_end(text: str, span: tuple[int, int]) -> tuple[bool, int]:
    """Whether the closing links are there, and how many small-print closers follow what ends the header."""
    tails = list(_tail_links(text, *span))
    small = next((t for t in tags(text, *span) if t.name == "small" and t.closing), None)
    end = (tails[-1] if tails else small).end if tails or small else span[1]
    return bool(tails), swallow(text, end, span[1], fixed.HEADER_CLOSERS)[1].count("small")


def notes(text: str, raw: bytes, spans: dict[str, tuple[int, int] | None], number: int, rejected: list[str]) -> dict[str, Any]:
    """``rejected``: parts of the update line that give no date."""
    own = {k: text[v[0] : v[1]] if v else "" for k, v in spans.items()}
    tail, closers = _header_end(text, spans["header"]) if spans["header"] else (True, 0)
    every = list(tags(text))
    updated = next(tags(own["updated"]), None)
    closed = close_of(own["updated"], updated, len(own["updated"])) if updated else None
    inner = own["updated"][updated.end : closed.start] if closed else ""
    before = [t for t in every if spans["title"] and t.end <= spans["title"][0]][-2:]
    broken, plain, low = text.find("�"), text.isascii(), text.lower()
    return {
        "blank": not raw.strip(),
        "mojibake": [excerpt(text, *m.span()) for m in (() if plain else _MOJIBAKE.finditer(text))][:1],
        "replaced": [excerpt(text, broken, broken + 1)] if broken >= 0 else [],
        "body_tag": any(t.name == "body" and not t.closing for t in every),
        "body_close": any(t.name == "body" and t.closing for t in every),
        "speech": any(w in low for w in fixed.SPEECH),
        "script": any(t.name == "script" and not t.closing for t in every),
        "title_swapped": [t.name for t in before] == ["b", "big"],
        "header_tail": tail,
        "header_closers": closers,
        "updated_open": next((t.name for t in tags(own["body"]) if not spans["updated"] and t.name in ("i", "em") and not t.closing and re.match(r"\s*updated\b", own["body"][t.end :], re.I)), None),
        "updated_nested": clip(inner) if updated and any(t.name == updated.name and not t.closing for t in tags(inner)) else None,
        "rejected_dates": rejected,
        "footer_bare": next((t.name == "b" for t in tags(own["footer"])), False),
        "header_words": [w for w in fixed.HEADER_WORDS if w in own["body"]],
        "footer_words": any(_refers(own["body"], t) for t in tags(own["body"]) if not t.closing) or fixed.DIALOGUE in own["body"].lower(),
        "own_links": sum(target_site(a["href"])[0] == number for a in anchors(clean(own["body"]))),
    }
