"""Text functions for hand-written HTML: pure Python, used in Arrow batches; what Spark can express is given as columns too."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_CONTROL = re.compile(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
_TAG = re.compile(r"<[^>]*>")
_WHITE = re.compile(r"[ \t\n\r\f\v]+")
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ANCHOR = re.compile(r"<a\b([^>]*)>", re.I)
#: Spaces of Unicode, which a trim without a list of characters takes from both ends.
SPACES = "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c) == "Zs")
_BREAK = re.compile(r"</?p\b[^>]*>|<br\b[^>]*>|<hr\b[^>]*>|</?(?:tr|li|table)\b[^>]*>|(?:(?:&nbsp;?| )\s*){3,}", re.I)


def decode_bytes(raw: bytes) -> tuple[str, str]:
    """Text and encoding: strict UTF-8, else CP1252, else Latin-1, which takes any byte."""
    for name, label in (("utf-8", "utf-8"), ("cp1252", "cp1252")):
        try:
            return raw.decode(name), label
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1"), "latin-1"


def normalise_source(text: str) -> str:
    return unicodedata.normalize("NFC", _CONTROL.sub("", text.replace("\r\n", "\n").replace("\r", "\n")))


def unescape(text: str) -> str:
    return unicodedata.normalize("NFC", html.unescape(text))


def entity_defects(text: str) -> list[str]:
    """Entities that no name stands for, and those that lack their semicolon."""
    return [m[0] for m in re.finditer(r"&[A-Za-z][A-Za-z0-9]*;?", text) if not m[0].endswith(";") and html.unescape(m[0] + ";") != m[0] + ";" or m[0].endswith(";") and html.unescape(m[0]) == m[0]]


def collapse(text: str) -> str:
    return " ".join(text.split())


def strip_tags(markup: str, entities: dict[str, str] | None = None) -> str:
    """Text without tags. As a browser reads it, also entities that lack their semicolon; with ``entities`` (each as written,
    and its character) those alone are read, in that order, only ASCII white space is collapsed, and any spaces are trimmed."""
    text = _TAG.sub(" ", markup)
    if entities is None:
        return collapse(unescape(text))
    for entity, character in entities.items():
        text = text.replace(entity, character)
    return _WHITE.sub(" ", text).strip(SPACES)


def attributes(blob: str) -> dict[str, str]:
    """Attributes by lower-case name; the last of a name wins."""
    return {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTRIBUTE.finditer(blob)}


def anchors(markup: str, entities: dict[str, str] | None = None) -> list[dict]:
    """href, text, unquoted, start of each anchor; an unclosed one takes the text up to the next."""
    out, found = [], list(_ANCHOR.finditer(markup))
    for i, m in enumerate(found):
        own = attributes(m[1])
        if "href" not in own:
            continue
        limit = found[i + 1].start() if i + 1 < len(found) else len(markup)
        closed = re.compile(r"</a\s*>", re.I).search(markup, m.end(), limit)
        unquoted = re.search(r"href\s*=\s*[^\s\"']", m[1], re.I) is not None
        out.append({"href": own["href"].strip(), "text": strip_tags(markup[m.end() : closed.start() if closed else limit], entities), "unquoted": unquoted, "start": m.start()})
    return out


def blocks(markup: str, entities: dict[str, str] | None = None, breaks: re.Pattern = _BREAK) -> list[str]:
    """Markup between breaks, without blank pieces. div and newline are no breaks."""
    return [b for b in breaks.split(markup) if strip_tags(b, entities)]


def fold(text: str) -> str:
    plain = unicodedata.normalize("NFD", text.lower())
    return collapse("".join(c for c in plain if not unicodedata.combining(c)))


def sort_key(name: str) -> str:
    """``Head, Tail`` read as ``tail head``, folded."""
    head, comma, tail = name.partition(",")
    return fold(f"{tail} {head}" if comma else name)


def clip(text: str | None, limit: int = 200) -> str | None:
    if text is None:
        return None
    text = collapse(text)
    return text if len(text) <= limit else text[: limit - 1] + "…"


def slug(label: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", label.lower()).strip("_") or "unnamed"


def content_sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def collapse_column(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def clip_column(text: Column, limit: int = 200) -> Column:
    flat = collapse_column(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def slug_column(label: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unnamed"))
