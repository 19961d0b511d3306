"""Secrets in texts and in what texts encode: a worklist of decoded layers, each scanned again."""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, patterns, and the least length of what must be that long.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # maximal runs, so the length may stand in the pattern
LEAST_VALUE = 12
LEAST_ACCESS = 18

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX)
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A run that goes on over lines which hold nothing else; the last may be short.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]{16,}+)*(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]++={0,2})(?=[\x20\t]*\r?(?:\n|\Z))")
_BREAK = re.compile(r"\s+")
#: Where compressed data may begin behind other bytes.
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
#: Bytes of a decompressed layer that are read at once; layers are cut at line ends.
_PIECE = 1 << 20
#: Characters of one line of such a layer that are scanned at once, and how many of them again with the next.
#: All of the layer's spans are the range of what was compressed, so a secret at a cut shows all the same.
_LINE, _AGAIN = 1 << 22, 1 << 16

SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,layers:string>>"


@dataclass
class _Layer:
    """Decoded text, and for each of its characters the range of the original it stands for.

    `low` is None where every character stands for the one range `whole`.
    """

    text: str
    low: Sequence[int] | None
    high: Sequence[int] | None
    whole: tuple[int, int]
    path: str

    def range(self, start: int, end: int) -> tuple[int, int]:
        return self.whole if self.low is None else (self.low[start], self.high[end - 1])


def scan(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping for each kind."""
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_VALUE:
            yield "assign", m.start(), m.end()
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST_ACCESS:
            yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _lines_with(text: str, pattern: re.Pattern[str]) -> Iterator[tuple[int, int]]:
    """Lines that the pattern is found in."""
    at = 0
    while m := pattern.search(text, at):
        start = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.end())
        end = len(text) if end < 0 else end
        yield start, end
        at = end


def _percent(m: re.Match[str]) -> list[tuple[str, int, int]] | None:
    """Characters of a run of percent escapes, each with its place in the run; bytes that are no UTF-8 stay escapes."""
    decoded = bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "surrogateescape")
    out, at, good = [], 0, False
    for c in decoded:
        if "\udc80" <= c <= "\udcff":
            out += [(m.group()[k], k, k + 1) for k in range(at, at + 3)]
            at += 3
            continue
        size = 3 * len(c.encode())
        out.append((c, at, at + size))
        at += size
        good = True
    return out if good else None


def _escape(m: re.Match[str]) -> list[tuple[str, int, int]] | None:
    code = int(next(filter(None, m.groups())), 16)
    return [(chr(code), 0, len(m.group()))] if code < 0xD800 or 0xDFFF < code < 0x110000 else None


def _rewritten(layer: _Layer, pattern: re.Pattern[str], decode, name: str) -> Iterator[_Layer]:
    """Lines of a layer with every escape replaced."""
    for start, end in _lines_with(layer.text, pattern):
        chars: list[str] = []
        low: list[int] = []
        high: list[int] = []

        def plain(a: int, b: int) -> None:
            chars.append(layer.text[a:b])
            for k in range(a, b):
                x, y = layer.range(k, k + 1)
                low.append(x)
                high.append(y)

        at = start
        for m in pattern.finditer(layer.text, start, end):
            found = decode(m)
            if found is None:
                continue
            plain(at, m.start())
            for c, a, b in found:
                x, y = layer.range(m.start() + a, m.start() + b)
                chars.append(c)
                low.append(x)
                high.append(y)
            at = m.end()
        if at > start:
            plain(at, end)
            yield _Layer("".join(chars), low, high, layer.whole, f"{layer.path}/{name}")


def _decompressor(raw: bytes):
    if raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _decompressed(raw: bytes, engine) -> Iterator[str]:
    """The content in stretches that end where lines end; damaged data yields what could be read.

    What follows the end of a stream is another one, whose content goes on with the text, or plain bytes.
    """
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    rest, data = "", raw
    while True:
        try:
            part = engine.decompress(data, _PIECE)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            break
        rest += decoder.decode(part)
        if (cut := rest.rfind("\n") + 1) and len(rest) >= _PIECE:
            yield rest[:cut]
            rest = rest[cut:]
        elif len(rest) >= _LINE:
            yield rest
            rest = rest[-_AGAIN:]
        if engine.eof:
            data = engine.unused_data.lstrip(b"\0")  # padding
            if engine := _decompressor(data):
                continue
            rest += decoder.decode(data)
            break
        data = getattr(engine, "unconsumed_tail", b"")
        if not part and not data:
            break
    if rest:
        yield rest


def _texts(raw: bytes) -> Iterator[str]:
    """What bytes may say: UTF-8 with what is none replaced, and UTF-16 of either order if there are NULs."""
    yield raw.decode("utf-8", "replace")
    if b"\0" in raw:
        for order in ("utf-16-le", "utf-16-be"):
            yield raw.decode(order, "replace")


def _plain(c: str) -> bool:
    return c.isprintable() or c in "\r\n\t"


def _aligned(body: str, at: int) -> bytes:
    """Bytes of a run of base64 read from its character `at` on."""
    size = len(body) - at
    size -= size % 4 == 1
    return base64.b64decode(body[at : at + size] + "=" * (-size % 4))


def _clean_from(body: str, at: int, raw: bytes) -> int | None:
    """The first character, 0 or behind a separator, from which on alignment `at` gives nothing but plain text."""
    text = raw.decode("utf-8", "surrogateescape")
    tail = next((k for k in range(len(text), 0, -1) if not _plain(text[k - 1])), 0)
    least = len(text[:tail].encode("utf-8", "surrogateescape"))
    k = at - 1 + (least + 2) // 3 * 4
    if k < 0:
        return 0
    while k + 16 < len(body):
        if body[k] in "+/" and (k + 1 - at) % 4 == 0:
            return k + 1
        k += 4
    return None


class _Inside:
    """Where the characters of a decoded text lie in the run that encodes it: three bytes are four characters.

    `begin` is the run's character at which the bytes begin, `place` gives the range of some of its characters.
    """

    def __init__(self, raw: bytes, begin: int, place: Callable[[int, int], tuple[int, int]], high: bool):
        decoded = raw.decode("utf-8", "surrogateescape")
        self.text = "".join("\ufffd" if "\udc80" <= c <= "\udcff" else c for c in decoded) if not raw.isascii() else decoded
        self.count, self.begin, self.place, self.high = len(decoded), begin, place, high
        self.ends = None  # of characters in bytes, unless each is a byte
        if not raw.isascii():
            self.ends = array("q")
            end = 0
            for c in decoded:
                end += 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
                self.ends.append(end)

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, k: int) -> int:
        k += self.count if k < 0 else 0
        if self.high:
            last = (k + 1 if self.ends is None else self.ends[k]) - 1
            end = self.begin + last // 3 * 4 + last % 3 + 2
            return self.place(end - 1, end)[1]
        first = k if self.ends is None else self.ends[k - 1] if k else 0
        start = self.begin + first // 3 * 4 + first % 3
        return self.place(start, start + 1)[0]


def _packed(body: str, path: str, place: Callable[[int, int], tuple[int, int]]) -> Iterator[_Layer]:
    """Layers of one run of base64; `place` gives the range of some characters of it.

    Spans in clean text are the run and the characters of it that encode them, spans in other layers the run alone.

    Where a run is no clean text from its first character on, other text may be glued to it: then all four alignments are
    read, as far as they decode, and compressed data is looked for anywhere.
    """
    body = body.replace("-", "+").replace("_", "/")

    def whole(begin: int) -> tuple[int, int]:
        return place(begin, begin + 1)[0], place(len(body) - 1, len(body))[1]

    for at in range(4):
        raw = _aligned(body, at)
        begin = _clean_from(body, at, raw)
        if begin is not None:
            clean = raw[(begin - at) // 4 * 3 :]
            low, high = (_Inside(clean, begin or at, place, end) for end in (False, True))
            if low.text:
                yield _Layer(low.text, low, high, whole(begin), f"{path}/base64")
            if begin == 0:
                return
            raw = raw[: (begin - at) // 4 * 3]
        elif at == 0 and (engine := _decompressor(raw)):
            parts = False
            for text in _decompressed(raw, engine):
                parts = True
                yield _Layer(text, None, None, whole(0), f"{path}/base64/compressed")
            if parts:
                return
        for text in _texts(raw):
            yield _Layer(text, None, None, whole(0), f"{path}/base64")
        for m in _MAGIC.finditer(raw):
            if engine := _decompressor(raw[m.start() :]):
                for text in _decompressed(raw[m.start() :], engine):
                    yield _Layer(text, None, None, whole(at + m.start() // 3 * 4), f"{path}/base64/compressed")


def _unpacked(layer: _Layer) -> Iterator[_Layer]:
    """What runs of base64 hold, as text or compressed; also runs over several lines, first as one."""
    for pattern in (_WRAPPED, _BASE64):
        for m in pattern.finditer(layer.text):
            body = _BREAK.sub("", m.group()).rstrip("=")
            # Characters of the run, line ends taken out, by their places in the layer; padding belongs to the last one.
            kept = None if len(body) + 2 >= m.end() - m.start() else array("q", (k for k in range(m.start(), m.end()) if not layer.text[k].isspace()))

            def place(a: int, b: int, m=m, kept=kept, size=len(body)) -> tuple[int, int]:
                end = m.end() if b == size else (m.start() + b if kept is None else kept[b - 1] + 1)
                return layer.range(m.start() + a if kept is None else kept[a], end)

            yield from _packed(body, layer.path, place)


def _below(layer: _Layer) -> Iterator[_Layer]:
    if "%" in layer.text:
        yield from _rewritten(layer, _PERCENT, _percent, "url")
    if "\\" in layer.text:
        yield from _rewritten(layer, _ESCAPE, _escape, "unicode")
    yield from _unpacked(layer)


class _Identity(list):
    """The root's places: each character stands for itself."""

    def __init__(self, add: int) -> None:
        super().__init__()
        self.add = add

    def __getitem__(self, k: int) -> int:
        return k + self.add


def spans_of(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, layers) of all spans in code points; `layers` is empty for spans of the text itself.

    Layers are worked off depth first, each as soon as it is decoded, until none decodes further. A layer met
    before at the same place is not entered again, which ends cycles such as archives that hold themselves.
    Of a layer only spans that hold something decoded count; where two layers show one span, the first stands.
    """
    found = {(kind, a, b): "" for kind, a, b in scan(text)}
    root = _Layer(text, _Identity(0), _Identity(1), (0, len(text)), "")
    work, seen = [_below(root)], set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        mark = hashlib.blake2b(repr((layer.whole, layer.low and (layer.low[0], layer.high[-1]))).encode() + layer.text.encode("utf-8", "replace"), digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        for kind, a, b in scan(layer.text):
            low, high = layer.range(a, b)
            if layer.low is None or high - low != b - a:
                found.setdefault((kind, low, high), layer.path[1:])
                if isinstance(layer.low, _Inside):  # the run is no use without it, so it is a span as well
                    found.setdefault((kind, *layer.whole), layer.path[1:])
        work.append(_below(layer))
    return sorted(((kind, a, b, path) for (kind, a, b), path in found.items()), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of `SPANS`: every row's spans by start and kind, with the layers they were found under.

    Null text: empty, no spans. Null and repeated ids are carried along row by row. Other columns are ignored.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string())]))
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "layers"), s, strict=True)) for s in spans_of(text.as_py() or "")] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(spans, SPANS)
