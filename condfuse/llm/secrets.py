"""Secret scan with a worklist of decoded layers."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the three kinds, in their order.  Only ASCII letters fold.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs that have the 24 characters
MIN_ASSIGN, MIN_ACCESS = 6, 20

RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Stretches on lines that follow each other, each up to a line end and from a line start on.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r\n|\n|\r)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: The rest of an escape behind its first character, where that came from an escape.
PERCENT_BODIES = {b"%": re.compile("[0-9A-Fa-f]{2}")}
ESCAPE_BODIES = {
    b"\\": re.compile(r"u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2})"),
    b"&": re.compile(r"#[xX]([0-9A-Fa-f]{1,6});|#([0-9]{1,7});"),
}
#: Where compressed data start: gzip, zlib, bzip2, xz.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0")
WORDS = tuple(w.encode() for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_CLASS = bytes(97 if c in _ALPHABET else 10 if c in b"\r\n" else 32 for c in range(256))
#: Bytes of unpacked data that are looked at in one go, and those that two such pieces share.
PIECE, OVERLAP = 4 << 20, 64 << 10


def scan(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the matches of each kind, leftmost and not overlapping."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def may_hold(raw: bytes) -> bool:
    """Whether a text can have a match or a layer at all: a keyword, an escape or a long run."""
    if b"%" in raw or b"\\" in raw or b"&#" in raw:
        return True
    lines = raw.translate(_CLASS).split(b"\n")
    if b"".join([x.strip(b" ") for x in lines] if len(lines) > 1 else lines).find(b"a" * 16) >= 0:
        return True
    low = raw.lower()
    return any(w in low for w in WORDS)


class _Layer:
    """A text and, for each of its characters, the span of the document's text it came from."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, decoded: bool = True):
        self.text, self.starts, self.ends, self.decoded = text, starts, ends, decoded

    def span(self, a: int, b: int) -> tuple[int, int]:
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())


def _widths(text: str) -> np.ndarray:
    """The bytes of each character; a byte that is no UTF-8 stands as one (lone surrogate) character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where((c >= 0xDC80) & (c <= 0xDCFF), 1, 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))


def _by_character(text: str, widths: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> _Layer:
    first = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(int)
    return _Layer(text, np.minimum.reduceat(starts, first), np.maximum.reduceat(ends, first))


def _text_layers(data: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[_Layer]:
    """Bytes with their source spans as UTF-16 where some are zero, and as text, whatever they are.

    Nothing is held here while the last one is out.
    """
    if b"\0" in data:
        for at, kind in ((0, "utf-16-le"), (1, "utf-16-le"), (0, "utf-16-be"), (1, "utf-16-be")):
            upto = len(data) - (len(data) - at) % 2
            text = data[at:upto].decode(kind, "replace")
            if re.search("[ -~]{3}", text):  # no match and no escape is shorter
                units = 2 + 2 * (np.frombuffer(text.encode("utf-32-le"), "<u4") >= 0x10000)
                yield _by_character(text, units, starts[at:upto], ends[at:upto])
    text = data.decode("utf-8", "surrogateescape")
    out = [_Layer(text, starts, ends) if len(text) == len(data) else _by_character(text, _widths(text), starts, ends)]
    del data, starts, ends, text
    yield out.pop()


def _chain(text: str, m: re.Match, value, bodies: dict[bytes, re.Pattern]) -> list[tuple[bytes, int]]:
    """What an escape becomes and where it then ends, level by level: ``%2541`` is ``%``, which with the ``41``
    behind it is an escape again.
    """
    levels = []
    while m is not None and (new := value(m)) is not None:
        levels.append((new, m.end()))
        m = bodies[new].match(text, m.end()) if new in bodies else None
    return levels


def _replaced(layer: _Layer, pattern: re.Pattern, value, bodies: dict[bytes, re.Pattern]) -> tuple[bytes, np.ndarray, np.ndarray] | None:
    """The bytes of the layer with its escapes decoded; unchanged characters keep their spans.

    All escapes are taken as many levels down as the shallowest has.  The levels that this skips
    end no escape: they only shorten the digits behind a ``%``, ``\\`` or ``&``, which no match contains.  The depths
    of a layer's escapes are few, as each takes its characters, so the layers of a chain grow with the root of its length.
    """
    text, sites, upto = layer.text, [], 0
    for m in pattern.finditer(text):
        if m.start() >= upto and (levels := _chain(text, m, value, bodies)):
            sites.append((m.start(), levels))
            upto = levels[-1][1]
    if not sites:
        return None
    depth = min(len(levels) for _, levels in sites)
    parts, starts, ends, at = [], [], [], 0

    def unchanged(upto: int) -> None:
        body = text[at:upto]
        widths = 1 if body.isascii() else _widths(body)
        parts.append(body.encode("utf-8", "surrogateescape"))
        starts.append(np.repeat(layer.starts[at:upto], widths))
        ends.append(np.repeat(layer.ends[at:upto], widths))

    for start, levels in sites:
        new, end = levels[depth - 1]
        unchanged(start)
        parts.append(new)
        starts.append(np.repeat(layer.starts[start], len(new)))
        ends.append(np.repeat(layer.ends[end - 1], len(new)))
        at = end
    unchanged(len(text))
    return b"".join(parts), np.concatenate(starts), np.concatenate(ends)


def _escape(m: re.Match) -> bytes | None:
    digits = next(g for g in m.groups() if g is not None)
    code = int(digits, 10 if m[0].endswith(f"#{digits};") else 16)
    return chr(code).encode() if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _escaped_byte(m: re.Match) -> bytes | None:
    return bytes([int(m[4], 16)]) if m.lastindex == 4 else _escape(m)


def _percent_byte(m: re.Match) -> bytes:
    return bytes([int(m[0][-2:], 16)])


def _once(data: bytes) -> Iterator[bytes]:
    yield data


def _member(data: bytes | memoryview):
    """A decompressor for the data that start here, None if they are not compressed."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 1 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    return None


def _drained(tool, data) -> Iterator[bytes]:
    """What a decompressor gives for ``data``, at most ``PIECE`` bytes at a time."""
    while True:
        out = tool.decompress(data, PIECE)
        if out:
            yield out
        data = getattr(tool, "unconsumed_tail", b"")
        if tool.eof or (not data and len(out) < PIECE and getattr(tool, "needs_input", True)):
            return


class _Packed:
    """Compressed data that start at byte ``at`` of a source, to be unpacked as often as asked, piece by piece.

    ``source`` gives the bytes of the source from its start, so compressed data inside compressed data are read
    through both and never held whole.
    """

    def __init__(self, source: Callable[[], Iterator[bytes]], at: int):
        self.source, self.at, self.took = source, at, 0

    def _input(self) -> Iterator[memoryview]:
        skip = self.at
        for data in self.source():
            if skip < len(data):
                yield memoryview(data)[skip:]
            skip = max(skip - len(data), 0)

    def pieces(self) -> Iterator[bytes]:
        """The unpacked bytes of all members that follow each other; zero bytes between them are padding.

        A member that is broken or cut counts as no data if that shows before it has given ``PIECE`` bytes.  ``took`` is
        then where the last whole member ends.
        """
        source, data, passed = self._input(), memoryview(b""), 0
        while True:
            while len(data) < 6 and (more := next(source, None)) is not None:
                data = memoryview(bytes(data) + bytes(more))
            if (tool := _member(data)) is None:
                return
            held, size = [], 0
            try:
                while True:
                    for out in _drained(tool, data):
                        held.append(out)
                        size += len(out)
                        if size >= PIECE:
                            yield from held
                            held = []
                    passed += len(data)
                    if tool.eof or (data := next(source, None)) is None:
                        break
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                return
            if not tool.eof:
                return
            yield from held
            data = memoryview(tool.unused_data)
            passed -= len(data)
            self.took = passed
            while len(data) and data[0] == 0 or not len(data):
                zeros = len(data) - len(bytes(data).lstrip(b"\0"))
                data, passed = data[zeros:], passed + zeros
                if not len(data):
                    if (data := next(source, None)) is None:
                        return

    def windows(self) -> Iterator[tuple[int, bytes]]:
        """The unpacked bytes in pieces that overlap, each with its offset."""
        held, offset, more = bytearray(), 0, False
        for out in self.pieces():
            held += out
            more = True
            if len(held) >= PIECE:
                yield offset, bytes(held)
                offset += len(held) - OVERLAP
                del held[:-OVERLAP]
                more = False
        if more:
            yield offset, bytes(held)


def _from_runs(layer: _Layer) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Base64 runs of a layer, decoded: the bytes, and the first and last character that each byte came from.

    A run is an unbroken one, or one over several lines, without the line ends.  Each is decoded at the four
    alignments, so whatever starts inside it, after a prefix or a separator, is in one of them up to the end of
    the run; what ``/``, ``_`` or ``-`` bound on both sides is also decoded alone.  A run that stands in the document's own
    text just so is the end of a run there (an escape before it ends in run characters) and was decoded with that.
    """

    def known(m: re.Match) -> bool:
        a, b = m.span()
        return layer.decoded and layer.ends[b - 1] - layer.starts[a] == b - a and bool((layer.ends[a:b] - layer.starts[a:b] == 1).all())

    def tries() -> Iterator[tuple[str, np.ndarray]]:
        for m in RUN.finditer(layer.text):
            if known(m):
                continue
            body = m[0].rstrip("=")
            at = np.arange(m.start(), m.start() + len(body))
            yield from ((body[k:], at[k:]) for k in range(4))
            if re.search("[/_-]", body):
                yield from ((p[0], at[p.start() : p.end()]) for p in re.finditer(r"[A-Za-z0-9+]{16,}", body))
        for m in WRAPPED.finditer(layer.text):
            if known(m):
                continue
            body = re.sub(r"[ \t\r\n=]+", "", m[0])
            if len(body) >= 16:
                at = m.start() + np.concatenate([np.arange(p.start(), p.end()) for p in re.finditer(r"[^ \t\r\n=]+", m[0])])
                yield from ((body[k:], at[k:]) for k in range(4))

    for body, at in tries():
        n = len(body) - (len(body) % 4 == 1)  # the bits of a last single character are no byte
        data = base64.b64decode(body[:n].replace("-", "+").replace("_", "/") + "=" * (-n % 4))
        k = np.arange(len(data))
        yield data, at[k * 4 // 3], at[np.minimum((k * 8 + 15) // 6, n) - 1]


def decoded_spans(text: str) -> tuple[set[tuple[int, int, int]], int]:
    """Spans found in decoded layers, mapped to the text, and the number of layers scanned.

    The worklist starts with the text itself.  A layer gives the bytes of each base64 run and of its Unicode escapes and of its
    URL escapes (the whole layer, decoded; ``\\x`` above 7F as a character and as a byte).
    Bytes are always scanned and decoded further: as text, where what is no UTF-8 stands as single characters, as UTF-16 where
    some are zero, and unpacked wherever compressed data start in them.  Bytes or a layer
    seen before from the same place are not taken again, so the list runs dry.  What a layer gives is made one
    by one and followed to its end, and a layer is let go when its last child is taken, so a chain of escapes holds one
    layer.  Unpacked data of more than ``PIECE`` bytes are taken in pieces, so their size does not matter.
    """
    base = np.arange(len(text) + 1, dtype=np.int32 if len(text) < 2**31 - 1 else np.int64)
    seen, found, layers = set(), set(), 0

    def new(kind: str, data: bytes, starts: np.ndarray, ends: np.ndarray) -> bool:
        key = (kind, hashlib.blake2b(data, digest_size=16).digest(), int(starts.min()), int(ends.max()))
        return key not in seen and not seen.add(key)

    def decoded(layer: _Layer) -> Iterator[tuple[bytes, np.ndarray, np.ndarray] | None]:
        for data, first, last in _from_runs(layer):
            yield data, layer.starts[first], layer.ends[last]
        data = first = last = None
        ways = []
        if "\\" in layer.text or "&#" in layer.text:
            ways.append((ESCAPE, _escape, ESCAPE_BODIES))
            if re.search(r"\\x[89A-Fa-f][0-9A-Fa-f]", layer.text):
                ways.append((ESCAPE, _escaped_byte, ESCAPE_BODIES))
        if "%" in layer.text:
            ways.append((PERCENT, _percent_byte, PERCENT_BODIES))
        while ways:
            out = [_replaced(layer, *ways.pop(0))]
            if not ways:
                del layer
            yield out.pop()

    def opened(data: bytes, starts: np.ndarray, ends: np.ndarray, offset: int = 0, source: Callable | None = None, done: list | None = None):
        """What is packed in the bytes, then the bytes as text.  Of a longer source they are a piece from ``offset`` on."""
        nonlocal layers
        if not (b"\0" in data or PACKED.search(data) or may_hold(data)):
            layers += 1  # nothing to find and nothing to decode
            return
        own, done = (source or partial(_once, data)), done or [0]
        for m in PACKED.finditer(data):
            at = offset + m.start()
            if at < done[0]:
                continue
            packed = _Packed(own, at)
            n = sum(1 for _ in packed.pieces())
            done[0] = at + packed.took
            if n:
                inside = slice(m.start(), at - offset + packed.took if packed.took else None)
                yield packed, int(starts[inside].min()), int(ends[inside].max())
        m = packed = own = None
        rest = _text_layers(data, starts, ends)
        del data, starts, ends, source
        yield from rest

    def unpacked(packed: _Packed, start: int, end: int):
        done = [0]
        for offset, data in packed.windows():
            where = np.broadcast_to(base[start], len(data)), np.broadcast_to(base[end], len(data))
            if new("bytes", data, *where):
                yield from opened(data, *where, offset, packed.pieces, done)

    work = [decoded(_Layer(text, base[:-1], base[1:], False))]
    while work:
        item = next(work[-1], work)
        if item is work:
            work.pop()
        elif isinstance(item, _Layer):
            if not new("text", item.text.encode("utf-8", "surrogateescape"), item.starts, item.ends):
                continue
            layers += 1
            for a, kind, b in scan(item.text):
                start, end = item.span(a, b)
                found.add((start, kind, end))
            work.append(decoded(item))
        elif item is not None and isinstance(item[0], _Packed):
            work.append(unpacked(*item))
        elif item is not None and item[0] and new("bytes", *item):
            work.append(opened(*item))
        item = None
    return found, layers


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers``.

    The counts and ``base_sha256`` are of the matches in the text itself; ``spans`` has those and the
    matches in decoded layers, as ``kind:start:end`` in code points of the document's text.  A match in a layer spans the
    source of its characters: exact to the escape or base64 group, the whole run where it was compressed.
    Every layer is scanned and decoded further, whatever its size; memory is a few times the text's, whatever it unpacks to.

    Null text is empty text.  Rows are independent: no shuffle, any order, repeated rows give repeated
    results, an empty table none; other columns are not read.
    """
    schema = "doc_id {}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"
    id_type = docs.schema["doc_id"].dataType
    nothing = hashlib.sha256(b"").hexdigest()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(1):
                raw = raw.as_py()
                if not may_hold(raw):
                    out.append((0, 0, 0, nothing, "", 0))
                    continue
                text = raw.decode("utf-8", "replace")
                base = scan(text)
                extra, layers = decoded_spans(text)
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                out.append((*(sum(k == kind for _, k, _ in base) for kind in range(3)), digest, joined({*base, *extra}), layers))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(scanned, schema.format(id_type.simpleString()))
