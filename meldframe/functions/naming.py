"""Identifier rules: snake-case renames, quoting, and helper names that can't clash with a user's columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

_SEPARATORS = re.compile(r"[^a-z0-9]+")


def snake_case(name: str) -> str:
    """Accents dropped, lower case, runs of anything else as one underscore; never empty, never starting with a digit."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    word = _SEPARATORS.sub("_", plain.lower()).strip("_")
    if not word or word[0].isdigit():
        return f"_{word}"
    return word


def unique_names(names: Iterable[str]) -> list[str]:
    """Snake-case names in order; a name already issued gets the first free suffix ``_1``, ``_2`` and so on."""
    issued: set[str] = set()
    result = []
    for base in map(snake_case, names):
        name, n = base, 0
        while name in issued:
            n += 1
            name = f"{base}_{n}"
        issued.add(name)
        result.append(name)
    return result


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def qualified(*parts: str) -> str:
    return ".".join(map(quoted, parts))


def free_name(wanted: str, *taken: Iterable[str]) -> str:
    """``wanted``, lengthened until no column of ``taken`` has that name in any letter case."""
    used = {c.lower() for columns in taken for c in columns}
    name = wanted
    while name.lower() in used:
        name += "_"
    return name
