"""Output templates such as ``{t} {[{L}]%bold} {s}``, parsed on the driver and compiled to one Column.

Specifiers: s message, L level, t timestamp, F file, f.. last parts of the file, l line,
m module path, c crate.  Parameters after ``:`` (or, of a nested segment, ``%``): a
colour, styles, and [<^>][0]width.  Rows without a level are printed as they are.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT = {(False, False): "{L} {s}", (True, False): "{t} {L} {s}", (False, True): "{L} {s}\n└─ {m} @ {F}:{l}", (True, True): "{t} {L} {s}\n└─ {m} @ {F}:{l}"}
_LOCATION = " {({c:bold} {fff}:{l:1})%dimmed}"
ONELINE = {(False, False): "{[{L}]%bold} {s}", (True, False): "{t} {[{L}]%bold} {s}", (False, True): "{[{L}]%bold} {s}" + _LOCATION, (True, True): "{t} {[{L}]%bold} {s}" + _LOCATION}
COLORS = {n: 30 + i for i, n in enumerate("black red green yellow blue magenta cyan white".split())} | {"purple": 35} | {f"bright {n}": 90 + i for i, n in enumerate("black red green yellow blue magenta cyan white".split())}
STYLES = {"bold": 1, "dimmed": 2, "italic": 3, "underline": 4, "strike": 9}
_SEVERITY = {4: 31, 3: 33, 2: 32, 1: 97, 0: 90}
_ANSI = "\x1b\\[[0-9;]*m"


class TemplateError(ValueError):
    pass


@dataclass
class Segment:
    """kind: a specifier, 'text' or 'nested'."""

    kind: str
    text: str = ""
    parts: list[Segment] = field(default_factory=list)
    color: str | None = None
    styles: tuple[str, ...] = ()
    width: int | None = None
    zero: bool = False
    align: str = "<"


def _parameters(segment: Segment, names: list[str]) -> Segment:
    for name in names:
        if m := re.fullmatch(r"([<^>]?)([0-9]+)", name):
            if segment.width is not None:
                raise TemplateError(f"two widths: {name}")
            segment.align, segment.width, segment.zero = m[1] or "<", int(m[2]), m[2].startswith("0")
        elif name in STYLES:
            if name in segment.styles:
                raise TemplateError(f"repeated style: {name}")
            segment.styles += (name,)
        elif name in COLORS or name in ("severity", "werror"):
            if segment.color is not None:
                raise TemplateError(f"two colours: {name}")
            segment.color = name
        else:
            raise TemplateError(f"unknown parameter: {name}")
    return segment


def _close(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return i
    raise TemplateError("unmatched bracket")


def _parse(text: str) -> list[Segment]:
    out, at = [], 0
    while at < len(text):
        if text[at] == "}":
            raise TemplateError("unmatched bracket")
        if text[at] != "{":
            end = min(x for x in (text.find("{", at), text.find("}", at), len(text)) if x >= 0)
            out.append(Segment("text", text[at:end]))
            at = end
            continue
        end = _close(text, at)
        body = text[at + 1 : end]
        at = end + 1
        if m := re.fullmatch(r"(f+|[cFlsLmt])((?::[^:{}%]+)*)", body):
            out.append(_parameters(Segment(m[1]), m[2].split(":")[1:]))
            continue
        inner, percent, names = body.rpartition("%")
        parts = _parse(inner if percent and "}" not in names else body)
        if not any(p.kind not in ("text",) for p in parts):
            raise TemplateError(f"no such specifier: {body!r}")
        out.append(_parameters(Segment("nested", parts=parts), names.split("%") if percent and "}" not in names else []))
    return out


def _has(segments: list[Segment], kind: str) -> bool:
    return any(s.kind == kind or _has(s.parts, kind) for s in segments)


def parse(text: str) -> list[Segment]:
    out = _parse(text)
    if not _has(out, "s"):
        raise TemplateError("a template must have {s}")
    return out


def preset(name: str, timestamp: bool, location: bool, host: bool = False) -> str:
    return {"default": DEFAULT, "oneline": ONELINE}[name][timestamp, location] + " (HOST)" * host


def warnings(text: str, has_timestamp: bool) -> list[str]:
    """Where the template and the stream disagree about timestamps."""
    wanted = _has(parse(text), "t")
    return ["the template has a timestamp, the stream has none"] if wanted and not has_timestamp else ["the stream has timestamps, the template has none"] if has_timestamp and not wanted else []


def _pad(x: Column, segment: Segment, default: int, colored: bool) -> Column:
    width = default if segment.width is None else segment.width
    if not width:
        return x
    fill = "0" if segment.zero else " "
    length = F.length(F.regexp_replace(x, _ANSI, "")) if colored else F.length(x)
    missing = F.greatest(F.lit(0), F.lit(width) - length)
    # padding added to what is there never truncates, as rpad would
    run = lambda n: F.repeat(F.lit(fill), n.cast("int"))
    if segment.align == "<":
        return F.concat(x, run(missing))
    if segment.align == ">":
        return F.concat(run(missing), x)
    before = F.floor(missing / 2)
    return F.concat(run(before), x, run(missing - before))


def _paint(x: Column, segment: Segment, color: str | None, level: Column) -> Column:
    codes = [F.lit(str(STYLES[s])) for s in segment.styles]
    if color == "severity" or color == "werror":
        kinds = _SEVERITY if color == "severity" else {4: 31, 3: 33}
        choice = None
        for k, code in kinds.items():
            choice = F.when(level == k, F.lit(str(code))) if choice is None else choice.when(level == k, F.lit(str(code)))
        codes.append(choice)
    elif color:
        codes.append(F.lit(str(COLORS[color])))
    if not codes:
        return x
    joined = F.concat_ws(";", *codes)
    return F.when(joined == "", x).otherwise(F.concat(F.lit("\x1b["), joined, F.lit("m"), x, F.lit("\x1b[0m")))


def render(template: str | list[Segment], columns: dict[str, Column], color: bool = False, diffs: bool = False) -> Column:
    """The text of a row; columns: message, level, timestamp, file, line, module.  diffs: failed comparisons are shown as ``assertion_diff``."""
    segments = parse(template) if isinstance(template, str) else template
    level, names = columns["level"], ["TRACE", "DEBUG", "INFO", "WARN", "ERROR"]
    null = F.lit(None).cast("string")

    def value(s: Segment) -> tuple[Column, int]:
        file, module = columns.get("file", null), columns.get("module", null)
        if s.kind == "s":
            return columns["message"], 0
        if s.kind == "t":
            stamp = columns.get("timestamp", null)
            return F.coalesce(F.nullif(stamp, F.lit("")), F.lit("<time>")), 0
        if s.kind == "L":
            return F.element_at(F.array(*map(F.lit, names)), level.cast("int") + 1), 5
        if s.kind == "F":
            return F.coalesce(file, F.lit("<file>")), 0
        if s.kind[0] == "f":
            root = F.when(file.startswith("/"), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>"))
            parts = F.concat(root, F.filter(F.split(file, "/"), lambda x: (x != "") & (x != ".")))
            n = len(s.kind)
            return F.coalesce(F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), n), "/"), F.lit("<file>")), 0
        if s.kind == "m":
            return F.coalesce(module, F.lit("<mod path>")), 0
        if s.kind == "c":
            parts = F.split(module, "::")
            return F.coalesce(F.when(F.size(parts) >= 2, parts[0]), F.lit("<crate>")), 0
        return F.coalesce(columns.get("line", null).cast("string"), F.lit("0")), 4

    def one(s: Segment) -> Column:
        if s.kind == "text":
            return F.lit(s.text)
        x, width = (F.concat(*map(one, s.parts)), 0) if s.kind == "nested" else value(s)
        if color:
            x = _paint(x, s, s.color or ("severity" if s.kind == "L" else None), level)
        return _pad(x, s, width, color)

    text = F.when(level.isNull(), columns["message"]).otherwise(F.concat(*map(one, segments)))
    return F.coalesce(assertion_diff(columns["message"]), text) if diffs else text


def diff(left: str, right: str) -> list[tuple[str, str]]:
    """Character runs of two texts: ('=', common), ('<', left only), ('>', right only)."""
    out = []
    for kind, a, b, c, d in difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if kind == "equal":
            out.append(("=", left[a:b]))
        else:
            out += [(k, t) for k, t in (("<", left[a:b]), (">", right[c:d])) if t]
    return out


def _sgr(text: str, *codes: int) -> str:
    return f"\x1b[{';'.join(map(str, codes))}m{text}\x1b[0m"


def assertion_text(message: str | None) -> str | None:
    """A failed comparison with its two values as a coloured difference; None for other messages."""
    lines = (message or "").splitlines()
    if len(lines) < 3 or not all(x.startswith(head) and x.endswith("`") and len(x) > len(head) for x, head in ((lines[-2], " left: `"), (lines[-1], "right: `"))):
        return None
    found = diff(lines[-2][8:-1], lines[-1][8:-1])
    out = [_sgr("\n".join(lines[:-2]), 1), f"{_sgr('diff', 1)} {_sgr('< left', 31)} / {_sgr('right >', 32)}"]
    for sign, color in (("<", 31), (">", 32)):
        out.append(_sgr(sign, color) + "".join(_sgr(t, color) if k == "=" else _sgr(t, color, 1) for k, t in found if k in ("=", sign)))
    return "\n".join(out)


@F.arrow_udf(T.StringType())
def _assertion(messages: pa.Array) -> pa.Array:
    return pa.array([assertion_text(m) for m in messages.to_pylist()], pa.string())


def assertion_diff(message: Column) -> Column:
    """Failed comparisons as a difference in colours, null for all other messages; only messages that end like one reach Python."""
    return F.when(message.rlike(r"(?s)\n left: `.*`\nright: `.*`\n?$"), _assertion(message))
