"""The producing side of a log stream: interned strings, their symbols, and the format strings of statements.

A producer interns each string once; the interner's rows are symbol rows as
``sources.catalog`` reads them, so that fixtures pass through a real catalog.
"""

from __future__ import annotations

from .codec import LEVELS

MAX_INDEX = (1 << 16) - 1


def escape(text: str) -> str:
    """JSON text; '@', which linkers take for a version mark, is escaped like a control character."""
    known = {"\\": "\\\\", '"': '\\"', "\n": "\\n"}
    return "".join(known.get(c) or (f"\\u{ord(c):04x}" if c == "@" or ord(c) < 32 or 127 <= ord(c) < 160 else c) for c in text)


def mangle(package: str, tag: str, data: str, disambiguator: int, crate: str) -> str:
    """The name of a string's symbol."""
    return f'{{"package":"{escape(package)}","tag":"{escape(tag)}","data":"{escape(data)}","disambiguator":"{disambiguator}","crate_name":"{escape(crate)}"}}'


class Interner:
    """Gives each statement an index of its own, and each plain string one for all its uses."""

    def __init__(self, prefix: str, package: str = "app", crate: str = "app"):
        self.prefix, self.package, self.crate = prefix, package, crate
        self.names: list[str] = []
        self.known: dict[tuple[str, str], int] = {}

    def add(self, tag: str, data: str, shared: bool = False) -> int:
        if shared and (tag, data) in self.known:
            return self.known[tag, data]
        if len(self.names) >= MAX_INDEX:
            raise ValueError("no index is left")
        self.names.append(mangle(self.package, self.prefix + tag, data, len(self.names), self.crate))
        self.known[tag, data] = len(self.names)
        return len(self.names)

    def intern(self, text: str) -> int:
        return self.add("str", text, shared=True)

    def statement(self, level: str, format: str) -> int:
        if level not in LEVELS and level != "println":
            raise ValueError(f"no such statement: {level}")
        return self.add(level, format)

    def timestamp(self, format: str) -> None:
        """At most one in a program; it has no index on the wire."""
        if any(tag == "timestamp" for tag, _ in self.known):
            raise ValueError("two timestamp formats")
        self.add("timestamp", format)

    def symbols(self, version: str = "4", encoding: str = "rzcobs") -> list[tuple[str, int, str, bytes | None]]:
        """(name, address, section, data)"""
        return [(f"{self.prefix}version_ = {version}", 0, "", None), (f"{self.prefix}encoding_ = {encoding}", 0, "", None), *((name, i + 1, ".formats", None) for i, name in enumerate(self.names))]


def _braces(expression: str) -> str:
    return expression.replace("{", "{{").replace("}", "}}")


def inspect(*expressions: str) -> list[tuple[str, str]]:
    """The statements that show expressions with their values; without any, an empty one."""
    return [("trace", f"{_braces(e)} = {{}}") for e in expressions] or [("trace", "")]


_PANICS = {"panic": ("explicit panic", ""), "todo": ("not yet implemented", "not yet implemented: "), "unimplemented": ("not yet implemented", "not yet implemented: "), "unreachable": ("internal error: entered unreachable code", "internal error: entered unreachable code: ")}


def panic(kind: str = "panic", format: str | None = None) -> tuple[str, str]:
    bare, head = _PANICS[kind]
    return "error", f"panicked at '{bare if format is None else head + format}'"


def check(condition: str, format: str | None = None) -> tuple[str, str]:
    """A failed assertion."""
    return "error", f"panicked at '{f'assertion failed: {_braces(condition)}' if format is None else format}'"


def compare(equal: bool, format: str | None = None) -> tuple[str, str]:
    """A failed comparison; its values come after the arguments of ``format``."""
    head = f"panicked at 'assertion failed: `(left {'==' if equal else '!='} right)`{'' if format is None else ': ' + format}'\n"
    return "error", head + (" left: `{:?}`\nright: `{:?}`" if equal else "left/right: `{:?}`")


def unwrap(expression: str, format: str | None = None) -> tuple[str, str]:
    """A result that is an error, which is the only argument where ``format`` is not given."""
    return "error", f"panicked at '{format}'" if format is not None else f"panicked at 'unwrap failed: {_braces(expression)}'\nerror: `{{:?}}`"


def structure(name: str, fields: list[tuple[str | None, str]]) -> str:
    """The format string of a record: named fields as ``name: {=type:?}``, fields without a name by place."""
    if not fields:
        return name
    if fields[0][0] is not None:
        return f"{name} {{{{ {', '.join(f'{n}: {{={t}:?}}' for n, t in fields)} }}}}"
    return f"{name}({', '.join(f'{{={t}}}' for _, t in fields)})"


def enumeration(variants: list[tuple[str, list[tuple[str | None, str]]]]) -> str:
    """The format string of an enumeration; one variant alone has no discriminant on the wire."""
    return "|".join(structure(*v) for v in variants)


def discriminant(index: int, variants: int) -> bytes:
    if variants == 1:
        return b""
    return index.to_bytes(1 if variants <= 0xFF else 2 if variants <= 0xFFFF else 4, "little")
