"""Operator 2, secret scans with a recursive decoding worklist.

A document's text is the first layer.  Each layer is scanned for secrets and for
encoded stretches: percent-encoding, backslash or character-reference escapes,
base64 (both alphabets), hexadecimal (each also wrapped to lines, and from each place of its groups
of characters, since a prefix may be of the same letters), and, anywhere among the bytes that these
give, gzip, zlib, bzip2, xz and zstandard streams (streams of one kind on end are one).  What a stretch decodes to is a new layer on the worklist, until
none is left.  Decoded bytes are scanned whatever they are: as UTF-8 in which bytes that
are not valid stand for Latin-1 characters, and as UTF-16 where stretches of them look like it.
A layer seen before (same content from the same place of the text) is not
taken again, which ends cycles such as an archive that unpacks to itself.  Every
layer carries a map from its characters to spans of the text, so a finding names
the place in the document that hides it, however deep.

Defined results.  Null and empty texts have no findings.  Rows are scanned one by
one: repeated rows repeat their findings, null ids stay null, other columns are
ignored.  Where patterns overlap the earlier start wins, then the pattern listed
first.  The same secret at the same place is reported once, at its least depth; places are the
same where they share more than half of the shorter one.
A decompressed layer of more than ``max_layer`` bytes is reported as a finding of
kind 'oversized_layer', unpacked once more and scanned in windows that overlap by a quarter.
What starts in one window's part is looked for with an eighth of a window around it at least;
a secret or encoded stretch in such a layer that is longer than that (4 MB) may be cut at a window's end.  Texts are scanned whole.  An empty
table gives no rows.  Secrets themselves are not returned: ``preview`` has the first
four characters, ``sha256`` the hash.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate, islice
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import batches
from .memory import task

MAX_LAYER, WINDOW = 64 << 20, 32 << 20

PATTERNS = {
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "aws_access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "github_token": r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{40,255})",
    "slack_token": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}",
    "google_api_key": r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}",
    "payment_key": r"(?<![A-Za-z0-9])[rs]k_live_[A-Za-z0-9]{16,}",
    "json_web_token": r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "assigned": r"""(?i:(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key))["']?[ \t]*[:=][ \t]*["']?[^\s"']{8,}""",
}
_SECRET = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: Lower-case texts that some part of every secret contains.
_HINTS = ("akia", "asia", "private key", "gh", "xox", "aiza", "k_live_", "eyj", "passw", "pwd", "secret", "token", "key")
_HINT_BYTES = [h.encode() for h in _HINTS]
#: Pieces that may have percent-encoding, and runs that may have escapes: each match takes all it can, so that long runs cost no more than their length.
_URL = re.compile(r"(?:[!-$&-~]|%[0-9A-Fa-f]{2})+")
_RUN = re.compile(r"[!-~]+")
_ONE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|(&(?:#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6})|quot|apos|amp|lt|gt);)")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_HEX = re.compile(r"(?:[0-9A-Fa-f]{2}){16,}[0-9A-Fa-f]?")
#: A break between lines, also one that is escaped.
_BREAK = r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*"
_BASE64_LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}(?:{_BREAK}[A-Za-z0-9+/_-]{{16,}})*(?:{_BREAK}[A-Za-z0-9+/_-]+)?={{0,2}}")
_HEX_LINES = re.compile(rf"[0-9A-Fa-f]{{16,}}(?:{_BREAK}[0-9A-Fa-f]{{16,}})*(?:{_BREAK}[0-9A-Fa-f]+)?")
_LINE = re.compile(_BREAK)
#: What bytes without a hint must hold to have layers of their own.
_CODED = re.compile(rb"%[0-9A-Fa-f]{2}|\\[ux]|&[#a-z]|[A-Za-z0-9+/_-]{16}")
#: ASCII in UTF-16; a leading zero byte may be the first one's upper half.
_WIDE = re.compile(rb"(\0?)(?:[\t\n\r -~]\0){4,}")
_LATIN = {0xDC00 + x: x for x in range(0x80, 0x100)}
_MAGIC = re.compile(rb"(?P<gzip>\x1f\x8b\x08[\0-\x1f])|(?P<bzip2>BZh[1-9](?:1AY&SY|\x17rE8P\x90))|(?P<xz>\xfd7zXZ\0)|(?P<zstd>\x28\xb5\x2f\xfd)|(?P<zlib>\x78[\x01\x5e\x9c\xda])", re.DOTALL)
_WRONG = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError)
PIECE = 1 << 20


class Oversized(Exception):
    pass


class _Zstd:
    """A zstandard frame, fed in small pieces, with the attributes of the other decompressors."""

    def __init__(self):
        self.inner, self.held, self.unused_data, self.eof, self.needs_input = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj(), memoryview(b""), b"", False, True

    def decompress(self, data, most: int) -> bytes:
        self.held = memoryview(data) if len(data) else self.held
        piece, self.held = self.held[:256], self.held[256:]
        out = self.inner.decompress(piece)
        self.eof, self.needs_input = self.inner.eof, not len(self.held)
        if self.eof:
            self.unused_data = self.inner.unused_data + bytes(self.held)
        return out


class _Zlib:
    """A zlib or gzip stream with the attributes of the other decompressors."""

    def __init__(self, bits: int):
        self.inner, self.unused_data, self.eof, self.needs_input = zlib.decompressobj(bits), b"", False, True

    def decompress(self, data, most: int) -> bytes:
        out = self.inner.decompress(data or self.inner.unconsumed_tail, most)
        self.eof, self.unused_data = self.inner.eof, self.inner.unused_data
        self.needs_input = not self.inner.unconsumed_tail and len(out) < most
        return out


_OPEN = {
    "gzip": lambda: _Zlib(31), "zlib": lambda: _Zlib(15), "bzip2": bz2.BZ2Decompressor, "xz": lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=256 << 20), "zstd": _Zstd,
}


class Stream:
    """The content of a compressed stream at the start of ``data``, in pieces; streams of its kind that follow at once belong to it.

    After the last piece ``used`` bytes of the data have been read; ``whole``: the streams came to their ends.
    """

    def __init__(self, kind: str, data):
        self.kind, self.data, self.used, self.whole = kind, data, 0, False

    def __iter__(self) -> Iterator[bytes]:
        rest = self.data
        while True:
            stream, feed = _OPEN[self.kind](), rest
            try:
                while True:
                    out = stream.decompress(feed, PIECE)
                    feed = b""
                    if out:
                        yield out
                    if stream.eof or not out and stream.needs_input:
                        break
            except _WRONG:
                return
            if not stream.eof:
                self.used = len(self.data)
                return
            self.whole = True
            rest = stream.unused_data
            self.used = len(self.data) - len(rest)
            more = _MAGIC.match(rest)
            if not more or more.lastgroup != self.kind:
                return


def decompress(data: bytes, limit: int = MAX_LAYER) -> tuple[str, bytes] | None:
    """The name and content of a compressed stream; None for anything else.  Raises Oversized beyond ``limit``."""
    if not (m := _MAGIC.match(data)):
        return None
    out = b"".join(_most(Stream(m.lastgroup, data), limit))
    if len(out) > limit:
        raise Oversized(m.lastgroup)
    return (m.lastgroup, out) if out else None


def _most(pieces: Iterable[bytes], limit: int) -> Iterator[bytes]:
    """Pieces, until they have more than ``limit`` bytes."""
    for piece in pieces:
        yield piece
        limit -= len(piece)
        if limit < 0:
            return


class Layer:
    """Text, and for each character the span of the document it comes from; ``rank`` above 0 if it is the packed form of other layers."""

    __slots__ = ("text", "starts", "ends", "kinds", "rank", "part")

    def __init__(self, text: str, starts, ends, kinds: tuple[str, ...] = (), rank: int = 0):
        self.text, self.starts, self.ends, self.kinds, self.rank, self.part = text, starts, ends, kinds, rank, range(len(text))

    def matches(self, pattern: re.Pattern) -> Iterator[re.Match]:
        """Those that start in this layer's part."""
        return (m for m in pattern.finditer(self.text) if m.start() in self.part)

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]

    def inner(self, kind: str, text: str, starts, ends) -> Layer:
        return Layer(text, starts, ends, (*self.kinds, kind), self.rank)


class _At:
    """A list that is worked out where it is read."""

    __slots__ = ("at",)

    def __init__(self, at: Callable[[int], int]):
        self.at = at

    def __getitem__(self, i: int) -> int:
        return self.at(i)


class Coded:
    """Bytes, and for each the span of the document it comes from; ``fixed`` if they all have the same; ``part``: those that are not another window's."""

    __slots__ = ("data", "starts", "ends", "kinds", "rank", "fixed", "part")

    def __init__(self, data: bytes, starts, ends, kinds: tuple[str, ...], rank: int, fixed: bool = False):
        self.data, self.starts, self.ends, self.kinds, self.rank, self.fixed = data, starts, ends, kinds, rank, fixed
        self.part = range(len(data))

    def view(self, text: str, sizes: Iterator[int] | None, first: int = 0) -> Layer:
        """A layer of ``text``, whose characters have ``sizes`` bytes (None: one each) from ``first`` on."""
        if self.fixed:
            layer = Layer(text, self.starts, self.ends, self.kinds, self.rank)
            if len(self.part) < len(self.data):
                at = range(first, first + len(text)) if sizes is None else array("q", islice(accumulate(sizes, initial=first), len(text)))
                layer.part = range(bisect_left(at, self.part.start), bisect_left(at, self.part.stop))
            return layer
        at = range(first, first + len(text) + 1) if sizes is None else list(accumulate(sizes, initial=first))
        return Layer(text, _At(lambda i: self.starts[at[i]]), _At(lambda i: self.ends[at[i + 1] - 1]), self.kinds, self.rank)


def views(coded: Coded) -> Iterator[Layer]:
    """The texts that these bytes may be, as far as any can have a secret or a layer."""
    data = coded.data
    low = data.lower()
    if any(h in low for h in _HINT_BYTES) or _CODED.search(data):
        text = data.decode("utf-8", "surrogateescape")
        if data.isascii():
            yield coded.view(text, None)
        else:
            sizes = (1 if c < "\x80" or "\udc80" <= c <= "\udcff" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in text)
            yield coded.view(text.translate(_LATIN), sizes)
    wide = set()
    for m in _WIDE.finditer(data):
        wide.add(("utf-16-le", m.end(1) % 2))
        if m[1]:
            wide.add(("utf-16-be", m.start() % 2))
    for code, first in sorted(wide):
        text = data[first : len(data) - (len(data) - first) % 2].decode(code, "surrogatepass")
        yield coded.view(text, (4 if c > "\uffff" else 2 for c in text), first)


def _url(layer: Layer, a: int, b: int) -> Coded:
    units, i = bytearray(), a  # bytes, and where each comes from
    where: list[tuple[int, int]] = []
    while i < b:
        c = layer.text[i]
        if c == "%" and _hex2(layer.text[i + 1 : i + 3]):
            units += unquote_to_bytes(layer.text[i : i + 3])
            where.append((i, i + 3))
            i += 3
        else:
            raw = c.encode("utf-8", "surrogatepass")
            units += raw
            where += [(i, i + 1)] * len(raw)
            i += 1
    return Coded(bytes(units), _At(lambda j: layer.starts[where[j][0]]), _At(lambda j: layer.ends[where[j][1] - 1]), (*layer.kinds, "url"), layer.rank)


def _hex2(x: str) -> bool:
    return len(x) == 2 and all(c in "0123456789abcdefABCDEF" for c in x)


def _escapes(layer: Layer, a: int, b: int) -> Layer | None:
    text, starts, ends, at = [], [], [], a
    for m in _ONE.finditer(layer.text, a, b):
        for i in range(at, m.start()):
            text.append(layer.text[i])
            starts.append(layer.starts[i])
            ends.append(layer.ends[i])
        at = m.end()
        got = html.unescape(m[3]) if m[3] else chr(int(m[1] or m[2], 16))
        low = "\udc00" <= got <= "\udfff" if len(got) == 1 else False
        if low and text and "\ud800" <= text[-1] <= "\udbff":  # two halves of one character
            text[-1] = (text[-1] + got).encode("utf-16", "surrogatepass").decode("utf-16")
            ends[-1] = layer.ends[m.end() - 1]
            continue
        for c in got:
            text.append(c)
            starts.append(layer.starts[m.start()])
            ends.append(layer.ends[m.end() - 1])
    for i in range(at, b):
        text.append(layer.text[i])
        starts.append(layer.starts[i])
        ends.append(layer.ends[i])
    return layer.inner("unicode", "".join(text), starts, ends) if text else None


def _bytes(layer: Layer, kind: str, chars: Sequence[int], data: bytes, group: int, width: int) -> Coded:
    """``data``, of which ``group`` bytes come from ``width`` of these characters of the layer."""
    last = len(chars) - 1
    starts, ends = _At(lambda j: layer.starts[chars[j // group * width]]), _At(lambda j: layer.ends[chars[min(last, (j // group + 1) * width - 1)]])
    return Coded(data, starts, ends, (*layer.kinds, kind), layer.rank)


def streams(coded: Coded, limit: int, oversized: list, later: list) -> Iterator[Coded]:
    """What the compressed streams anywhere in these bytes unpack to; ``later`` gets the windows of those beyond ``limit``."""
    data, at = coded.data, coded.part.start
    while (m := _MAGIC.search(data, at)) and m.start() in coded.part:
        rest = memoryview(data)[m.start() :]
        stream = Stream(m.lastgroup, rest)
        pieces = iter(stream)
        out = b"".join(_most(pieces, limit))
        for _ in pieces if len(out) > limit else ():
            pass  # to its end, for the place
        start, end = coded.starts[m.start()], coded.ends[m.start() + stream.used - 1 if stream.used else len(data) - 1]
        new = Coded(out, _At(lambda _, x=start: x), _At(lambda _, x=end: x), (*coded.kinds, m.lastgroup), coded.rank, True)
        if len(out) > limit:
            oversized.append((start, end, coded.kinds))
            later.append(windows(new, Stream(m.lastgroup, rest), min(limit, WINDOW)))
            new.data = b""
        elif out:
            yield new
        at = m.start() + (stream.used if stream.whole else 1)


def windows(like: Coded, pieces: Iterable[bytes], size: int) -> Iterator[Coded]:
    """Overlapping windows of the content, each with the part that is its own."""
    margin = size // 8
    held, lo = bytearray(), 0

    def window(data: bytes, part: range) -> Coded:
        new = Coded(data, like.starts, like.ends, like.kinds, like.rank, True)
        new.part = part
        return new

    for piece in pieces:
        held += piece
        while len(held) > size:
            yield window(bytes(held[:size]), range(lo, size - margin))
            del held[: size - 2 * margin]
            lo = margin
    yield window(bytes(held), range(lo, len(held)))


def children(layer: Layer) -> Iterator[Layer | Coded]:
    text = layer.text
    if "%" in text:
        for m in layer.matches(_URL):
            if text.find("%", *m.span()) >= 0:
                yield _url(layer, *m.span())
    if _ONE.search(text):
        for m in layer.matches(_RUN):
            if _ONE.search(text, *m.span()) and (new := _escapes(layer, *m.span())):
                data = new.text.encode("latin-1", "replace")
                if _MAGIC.search(data):
                    yield Coded(data, new.starts, new.ends, new.kinds, new.rank)
                    new.rank += 1
                yield new
    lines = "\n" in text or "\\n" in text
    for m in layer.matches(_HEX):
        yield from _phases(layer, "hex", m[0], range(*m.span()))
    for m in layer.matches(_HEX_LINES) if lines else ():
        yield from _joined(layer, "hex", m)
    for m in layer.matches(_BASE64):
        yield from _phases(layer, "base64", m[0], range(*m.span()))
    for m in layer.matches(_BASE64_LINES) if lines else ():
        yield from _joined(layer, "base64", m)


def _phases(layer: Layer, kind: str, body: str, chars: Sequence[int]) -> Iterator[Coded]:
    """What an encoded stretch gives, from each place of a group on; ``chars``: where its characters are."""
    if kind == "hex":
        for first in (0, 1):
            yield _bytes(layer, kind, chars[first:], bytes.fromhex(body[first : len(body) - (len(body) - first) % 2]), 1, 2)
        return
    body = body.rstrip("=").replace("-", "+").replace("_", "/")
    for first in range(4):
        part = body[first : len(body) - ((len(body) - first) % 4 == 1)]
        yield _bytes(layer, kind, chars[first:], binascii.a2b_base64(part + "=" * (-len(part) % 4)), 3, 4)


def _joined(layer: Layer, kind: str, m: re.Match) -> Iterator[Coded]:
    """What neighbouring lines give as one stretch."""
    parts, chars, at = [], [], m.start()
    for gap in _LINE.finditer(layer.text, *m.span()):
        parts.append(layer.text[at : gap.start()])
        chars += range(at, gap.start())
        at = gap.end()
    if parts:
        parts.append(layer.text[at : m.end()])
        yield from _phases(layer, kind, "".join(parts), [*chars, *range(at, m.end())])


def once(found: list[tuple]) -> list[tuple]:
    """Without those whose secret has been found, no deeper, at a place that shares more than half of the shorter."""
    kept: dict[tuple, list[tuple]] = {}
    for x in sorted(found, key=lambda x: (x[6], x[3], x[2] - x[1], x[1])):
        same = kept.setdefault((x[0], x[5]), [])
        if not any(2 * (min(x[2], y[2]) - max(x[1], y[1])) > min(x[2] - x[1], y[2] - y[1]) for y in same if x[3]):
            same.append(x)
    return [x[:6] for same in kept.values() for x in same]


def scan(text: str, limit: int = MAX_LAYER) -> list[tuple[str, int, int, int, str, str]]:
    """(kind, start, end, depth, layers, secret) of a document's findings, by place."""
    work: deque[Layer | Coded] = deque([Layer(text, range(len(text)), _At(lambda i: i + 1))])
    seen: dict[tuple, int] = {}  # the least rank of each
    best: dict[tuple, tuple] = {}
    oversized: list = []
    later: list[Iterator[Coded]] = []
    while work or later:
        if not work:  # one window at a time
            if window := next(later[-1], None):
                work.append(window)
            else:
                later.pop()
            continue
        layer = work.popleft()
        if isinstance(layer, Coded):
            mark = (layer.starts[0], layer.ends[len(layer.data) - 1], hashlib.sha256(layer.data).digest(), layer.part)
            if layer.rank < seen.get(mark, layer.rank + 1):
                seen[mark] = layer.rank
                unpacked = list(streams(layer, limit, oversized, later))
                layer.rank += bool(unpacked)
                work.extend(new for new in views(layer) if new.text)
                work.extend(unpacked)
            continue
        if layer.kinds:
            mark = (layer.starts[0], layer.ends[len(layer.text) - 1], hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), "", layer.part)
            if layer.rank >= seen.get(mark, layer.rank + 1):
                continue
            seen[mark] = layer.rank
        low = layer.text.lower()
        if any(h in low for h in _HINTS):
            for m in layer.matches(_SECRET):
                start, end = layer.span(*m.span())
                key = (m.lastgroup, start, end, m[0])
                if key not in best or (best[key][6], best[key][3]) > (layer.rank, len(layer.kinds)):
                    best[key] = (m.lastgroup, start, end, len(layer.kinds), ">".join(layer.kinds), m[0], layer.rank)
        work.extend(new for new in children(layer) if isinstance(new, Coded) or new.text != layer.text)
    for start, end, kinds in oversized:
        best.setdefault(("oversized_layer", start, end, ""), ("oversized_layer", start, end, len(kinds), ">".join(kinds), "", 0))
    return sorted(once(list(best.values())), key=lambda x: (x[1], x[2], x[0], x[3], x[5]))


def secret_scan(docs: DataFrame, max_layer: int = MAX_LAYER) -> DataFrame:
    """(doc_id, kind, start_char, end_char, depth, layers, preview, sha256): a row for each finding."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            rows = [(doc, *found) for doc, text in zip(batch.column(0).to_pylist(), texts) if text for found in scan(text, max_layer)]
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int32()), pa.array(columns[5], pa.string()),
                    pa.array([x[:4] for x in columns[6]], pa.string()), pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in columns[6]], pa.string()),
                ],
                names=["doc_id", "kind", "start_char", "end_char", "depth", "layers", "preview", "sha256"],
            )

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(task(run), "doc_id long, kind string, start_char int, end_char int, depth int, layers string, preview string, sha256 string")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
