"""Corrections of page records by hand. Each names the page's digest, so a page that changed is not corrected blindly."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def steps(path: str) -> list[str | int]:
    """``header.coordinates[1].label`` as keys and places."""
    return [m[1] if m[1] is not None else int(m[2]) for m in _STEP.finditer(path)]


def value_at(record: Any, path: list[str | int]) -> Any:
    """The value at a path; None below a None."""
    return reduce(lambda own, step: None if own is None else own[step] if isinstance(step, int) else own.get(step), path, record)


def correct(record: dict, override: dict | None, digest: str) -> str | None:
    """Set the values of an override in ``record``; its status: active, stale (the page changed), superseded (nothing to do)."""
    if override is None:
        return None
    if override["applies_to_sha256"] != digest:
        return "stale"
    wrong = [(steps(f["field_path"]), f["value"]) for f in override.get("fix", []) if value_at(record, steps(f["field_path"])) != f["value"]]
    for path, value in wrong:
        value_at(record, path[:-1])[path[-1]] = value
    return "active" if wrong else "superseded"


def template(number: int, digest: str, author: str, path: str, value: str) -> str:
    """A file for one correction, in TOML."""
    return f'site = {number}\napplies_to_sha256 = "{digest}"\nauthor = "{author}"\n\n[[fix]]\nfield_path = "{path}"\nvalue = {value}\nrationale = ""\n'
