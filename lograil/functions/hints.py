"""Display hints as Column expressions, for integers of at most 63 bits: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _padded(digits: Column, width: int, prefix: str = "") -> Column:
    """Zeros up to ``width``, the prefix counted; longer digits are not cut."""
    room = max(0, width - len(prefix))
    body = F.when(F.length(digits) >= room, digits).otherwise(F.lpad(digits, room, "0")) if room else digits
    return F.concat(F.lit(prefix), body) if prefix else body


def decimal(x: Column, width: int = 0) -> Column:
    """Zero padding goes behind the sign."""
    digits = F.abs(x).cast("string")
    return F.when(x < 0, F.concat(F.lit("-"), _padded(digits, max(0, width - 1)))).otherwise(_padded(digits, width)) if width else x.cast("string")


def hexadecimal(x: Column, width: int = 0, alternate: bool = False, upper: bool = False, bits: int = 64) -> Column:
    """Two's complement at ``bits``."""
    digits = F.hex(x.cast("long") if bits == 64 else x.cast("long").bitwiseAND(F.lit((1 << bits) - 1)))
    return _padded(digits if upper else F.lower(digits), width, "0x" if alternate else "")


def binary(x: Column, width: int = 0, alternate: bool = False) -> Column:
    return _padded(F.bin(x), width, "0b" if alternate else "")


def octal(x: Column, width: int = 0, alternate: bool = False) -> Column:
    return _padded(F.conv(x.cast("string"), 10, 8), width, "0o" if alternate else "")


def _div(x: Column, n: int) -> Column:
    return F.call_function("div", x, F.lit(n).cast("long"))


def seconds(x: Column, places: int) -> Column:
    """sec.frac of micro- (6) or milliseconds (3)."""
    unit = 10**places
    return F.concat(_div(x, unit).cast("string"), F.lit("."), F.lpad((x % unit).cast("string"), places, "0"))


def clock(x: Column, places: int) -> Column:
    """[days:]hours:minutes:seconds[.fraction]; places: 6, 3 or 0 decimals of the unit."""
    unit = 10**places
    s = _div(x, unit) if places else x
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    days = _div(s, 86_400)
    out = [F.when(days > 0, F.concat(days.cast("string"), F.lit(":"))).otherwise(F.lit("")), two(_div(s, 3600) % 24), F.lit(":"), two(_div(s, 60) % 60), F.lit(":"), two(s % 60)]
    if places:
        out += [F.lit("."), F.lpad((x % unit).cast("string"), places, "0")]
    return F.concat(*out)


def iso8601(x: Column, millis: bool = True) -> Column:
    """UTC text of epoch milliseconds or seconds, from 1970 to 9999, whatever the session's time zone."""
    s = _div(x, 1000) if millis else x
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    day = F.date_add(F.lit("1970-01-01").cast("date"), _div(s, 86_400).cast("int")).cast("string")
    out = [day, F.lit("T"), two(_div(s, 3600) % 24), F.lit(":"), two(_div(s, 60) % 60), F.lit(":"), two(s % 60)]
    return F.concat(*out, *([F.lit("."), F.lpad((x % 1000).cast("string"), 3, "0")] if millis else []), F.lit("Z"))


def bits(x: Column, start: int, end: int) -> Column:
    """Bits start..end."""
    return F.shiftrightunsigned(x.cast("long"), start).bitwiseAND(F.lit((1 << (end - start)) - 1))


def bitflags(x: Column, flags: list[tuple[str, int]]) -> Column:
    """Names of all flags that are set, in order; a zero flag only for zero."""
    names = [F.when(x == 0 if v == 0 else x.bitwiseAND(F.lit(v)) == v, F.lit(name)) for name, v in flags]
    text = F.concat_ws(" | ", *names)
    return F.when(text == "", F.lit("(empty)")).otherwise(text)


def byte_list(raw: Column, kind: str = "") -> Column:
    """``[1, 2]`` of a binary column: kind '' decimal, 'x' hexadecimal, '#x' with prefix."""
    pairs = F.regexp_extract_all(F.hex(raw), F.lit("(..)"), F.lit(1))
    one = {"": lambda h: F.conv(h, 16, 10), "x": lambda h: F.lower(F.conv(h, 16, 16)), "#x": lambda h: F.concat(F.lit("0x"), F.lower(F.conv(h, 16, 16)))}[kind]
    return F.concat(F.lit("["), F.array_join(F.transform(pairs, one), ", "), F.lit("]"))


def little_endian(x: Column, size: int) -> Column:
    """The low ``size`` bytes of an integer, lowest first, as binary."""
    digits = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(size))))


def from_little_endian(raw: Column, at: int, size: int, signed: bool = False) -> Column:
    """An integer of ``size`` bytes at offset ``at`` of a binary column, as long (unsigned 64 bit values as decimal(20,0))."""
    digits = F.hex(F.substring(raw, at + 1, size))
    swapped = F.concat(*(F.substring(digits, 2 * (size - i) - 1, 2) for i in range(size)))
    value = F.conv(swapped, 16, 10).cast("decimal(20,0)")
    if not signed:
        return value if size == 8 else value.cast("long")
    half, full = 1 << (8 * size - 1), 1 << (8 * size)
    return F.when(value >= F.lit(half).cast("decimal(20,0)") if size < 8 else value > F.lit((1 << 63) - 1).cast("decimal(20,0)"), value - F.lit(str(full)).cast("decimal(20,0)")).otherwise(value).cast("long")
