"""Level and module filters: a directive list such as ``app::net=info,app::noisy=off`` as a predicate.

Directives are read from the right, so the last one for a path wins.  ``path=level``
sets a level, ``path`` alone means trace, a bare level is the crate's fallback.
Paths of other crates do not matter; without any directive the crate logs errors.
The innermost module that has a directive decides.  Rows without a level (prints) pass.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = {"trace": 0, "debug": 1, "info": 2, "warn": 3, "error": 4, "off": None}
OFF = 5
_IDENT = re.compile(r"[^\W\d]\w*")


class DirectiveError(ValueError):
    pass


def parse_directives(text: str, crate: str) -> dict[str, int | None]:
    """Least level by module path of ``crate``; None: off."""
    found: dict[str, int | None] = {}
    fallback: list[int | None] = []
    for part in reversed(text.split(",")):
        if not part:
            continue
        path, equals, level = part.rpartition("=")
        if equals:
            if level not in LEVELS:
                raise DirectiveError(f"unknown level: {level!r}")
            value = LEVELS[level]
        elif part in LEVELS:
            fallback.append(LEVELS[part])
            continue
        else:
            path, value = part, 0
        names = path.split("::")
        if not all(_IDENT.fullmatch(n) for n in names):
            raise DirectiveError(f"not a module path: {path!r}")
        if names[0] == crate:
            found.setdefault(path, value)
    found.setdefault(crate, fallback[0] if fallback else LEVELS["error"])
    return found


def within(module: Column, path: str) -> Column:
    """Whole segments only: ``foo`` holds ``foo::bar``, not ``fooo``."""
    return (module == path) | module.startswith(path + "::")


def directive_filter(text: str, crate: str, module: Column, level: Column) -> Column:
    """The predicate of a directive list, of Columns alone.  The least level of all directives is a conjunct of its own, which scans can take."""
    least, found = F.when(level.isNull(), F.lit(True)), parse_directives(text, crate)
    for path, value in sorted(found.items(), key=lambda x: (-x[0].count("::"), x[0])):
        least = least.when(within(module, path), level >= F.lit(OFF if value is None else value))
    lowest = min(OFF if v is None else v for v in found.values())
    return (level.isNull() | (level >= F.lit(lowest))) & F.coalesce(least.otherwise(F.lit(False)), F.lit(False))


def level_at_least(level: Column, least: str) -> Column:
    return level.isNull() | (level >= F.lit(LEVELS[least] if LEVELS[least] is not None else OFF))


def modules_on_for(text: str, crate: str, level: str) -> list[str]:
    """The paths with a directive that lets ``level`` pass."""
    return sorted(p for p, v in parse_directives(text, crate).items() if v is not None and LEVELS[level] >= v)


def modules_off_for(text: str, crate: str, level: str) -> list[str]:
    return sorted(p for p, v in parse_directives(text, crate).items() if v is None or LEVELS[level] < v)


def device_only(origin: Column, verbose: bool = False) -> Column:
    return F.lit(True) if verbose else origin == "device"
