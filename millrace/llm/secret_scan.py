"""Secret scans that look through encodings.

A worklist starts with the text. Every layer is scanned with the same patterns, then its percent-encoded and backslash-
escaped characters (all of the layer at once), its base64 runs and the compressed data in it are decoded into further
layers, until nothing new appears. Bytes become one character each, so no byte makes a layer unreadable. Layers
remember where each of their characters came from, so findings in decoded layers point at the text itself. A layer
that was seen before is not opened again, which ends cycles. Escapes of escapes are peeled one level a layer for
``ESCAPES`` levels; whatever is nested deeper is then decoded to its fixpoint in one pass over the text, so the number of
layers does not grow with the depth of the nesting (the readings in between are not scanned one by one).

Base64 runs go on over line ends and are decoded at all four offsets, so whatever stands before the data doesn't put
them out of step. Compressed data is opened wherever its header is found in decoded bytes, all gzip members, up to the
first fault. Output beyond ``WINDOW`` bytes is scanned in windows that overlap; compressed data in it goes on over
their borders, and of the rest only what is longer than ``OVERLAP`` and lies over a border can be missed.

Defined cases: a null or empty text has no spans; spans are in code points of the original text; rows are independent;
other columns are ignored. A document whose compressed data opens into more than ``MAX_OPENED`` bytes, or nests deeper
than ``MAX_DEPTH``, is a bomb: what is left is not opened, and its span is listed as ``unopened@...``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame

from .batches import per_text

MAX_OPENED, MAX_DEPTH = 1 << 36, 1000
#: Layers of escapes inside one another that are scanned each; deeper ones are decoded to the end at once.
ESCAPES = 4
#: Bytes of decompressed output that are one layer, and how many of them the next one repeats.
WINDOW, OVERLAP = 1 << 26, 1 << 20
#: Bytes given to the decompressor at once.
PIECE = 1024
#: The shortest base64 run that is opened.
LEAST_BASE64 = 16

#: Kinds in their order, patterns, the group that must be long, and how long.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")

ONE_PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
ONE_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))")
ESCAPE_RUN = re.compile(r"[%\\][%\\ux0-9A-Fa-f]*")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST_BASE64)
LINE_END = re.compile(r"(?<=[A-Za-z0-9+/_-])\r?\n[ \t]*(?=[A-Za-z0-9+/_-])")
_LINE_END = re.compile(rb"\r?\n[ \t]*")
WIDE = re.compile("[^\x00-\xff]")
COMPRESSED = re.compile("\x1f\x8b\x08|x[\x01\x5e\x9c\xda]")

_HEX_MAP = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_BASE64_MAP = bytes(120 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" else 32 for b in range(256))
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


class Shifts:
    """Places in a text after some of its stretches became one character each (``width`` 1) or were cut out (0)."""

    def __init__(self, width: int) -> None:
        self.width, self.at, self.start, self.end = width, [], [], []

    def add(self, at: int, start: int, end: int) -> None:
        self.at.append(at)
        self.start.append(start)
        self.end.append(end)

    def place(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.at, i) - 1
        if k < 0:
            return i, i + 1
        if self.width and self.at[k] == i:
            return self.start[k], self.end[k]
        i += self.end[k] - self.at[k] - self.width
        return i, i + 1

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.place(start)[0], self.place(end - 1)[1]

    def touched(self, start: int, end: int) -> bool:
        """Whether a replaced character is in the span or beside it."""
        return bisect_left(self.at, start - 1) < bisect_left(self.at, end + 1)


class Layer:
    """Decoded text, where its spans are in the layer above, and the encodings passed."""

    def __init__(self, text: str, up: Layer | None = None, span: Callable[[int, int], tuple[int, int]] | None = None, how: str = "",
                 whole: bool = False, touched: Callable[[int, int], bool] = lambda start, end: True,
                 source: Callable[[], Iterable[bytes]] | None = None) -> None:
        self.text, self.up, self._span, self.touched, self.source = text, up, span, touched, source
        self.depth = up.depth + 1 if up else 0
        self.escapes = up.escapes + 1 if up and how in ("url", "unicode") else 0
        self.padded = how == "base64"
        self.path = how if not up or not up.path else f"{up.path}{'+' if source else '>'}{how}"
        self.whole = whole or bool(up and up.whole)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The span in the text itself."""
        layer = self
        while layer.up:
            start, end = layer._span(start, end)
            layer = layer.up
        return start, end


class Bomb(Exception):
    pass


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in one layer."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def _replaced(text: str, pattern: re.Pattern) -> tuple[str, Shifts]:
    """The text with each escape as the character it stands for."""
    out, shifts, at, size = [], Shifts(1), 0, 0
    for m in pattern.finditer(text):
        out.append(text[at:m.start()])
        size += m.start() - at
        shifts.add(size, m.start(), m.end())
        out.append(chr(int(m[m.lastindex], 16)))
        size, at = size + 1, m.end()
    return "".join([*out, text[at:]]), shifts


def _escaped(out: list[str]) -> int:
    """How many characters at the end of ``out`` are one escape."""
    for size, sign in ((3, "%"), (4, "\\x"), (6, "\\u")):
        tail = "".join(out[-size:])
        if len(tail) == size and tail.startswith(sign) and all(c in "0123456789abcdefABCDEF" for c in tail[len(sign):]):
            return size
    return 0


def _settled(text: str) -> tuple[str, Shifts]:
    """The text with escapes decoded until none is left, those that decoded characters complete included."""
    parts, shifts, at, size = [], Shifts(1), 0, 0
    for m in ESCAPE_RUN.finditer(text):
        parts.append(text[at:m.start()])
        size += m.start() - at
        out, spans = [], []  # characters, and the (start, end) that each stands for
        for i, c in enumerate(m[0], m.start()):
            out.append(c)
            spans.append((i, i + 1))
            while n := _escaped(out):
                code = "".join(out[-n:]).lstrip("%\\ux")
                out[-n:], spans[-n:] = [chr(int(code, 16))], [(spans[-n][0], i + 1)]
        for k, (start, end) in enumerate(spans):
            if end - start > 1:
                shifts.add(size + k, start, end)
        parts.extend(out)
        size, at = size + len(out), m.end()
    return "".join([*parts, text[at:]]), shifts


def _unwrapped(text: str) -> tuple[str, Shifts]:
    """The text without the line ends, and the indents after them, inside base64 runs."""
    out, shifts, at, size = [], Shifts(0), 0, 0
    for m in LINE_END.finditer(text):
        out.append(text[at:m.start()])
        size += m.start() - at
        shifts.add(size, m.start(), m.end())
        at = m.end()
    return "".join([*out, text[at:]]), shifts


class Inflate:
    """Output of the gzip members or the zlib stream that ``chunks`` begin with, up to the first fault."""

    def __init__(self, chunks: Iterable[bytes]) -> None:
        self.chunks, self.used, self.cut = chunks, 0, False

    def __iter__(self) -> Iterator[bytes]:
        d, fed, gzip = zlib.decompressobj(47), 0, None
        for chunk in self.chunks:
            for k in range(0, len(chunk), PIECE):
                piece = chunk[k:k + PIECE]
                gzip = piece[:1] == b"\x1f" if gzip is None else gzip
                while piece:
                    if d is None:  # after a member: padding, the next one, or something else
                        rest = piece.lstrip(b"\0")
                        fed += len(piece) - len(rest)
                        if rest and (not gzip or rest[:1] != b"\x1f"):
                            return
                        piece, d = rest, zlib.decompressobj(31) if rest else None
                        continue
                    before = d.copy()
                    try:
                        out = d.decompress(piece)
                    except zlib.error:
                        yield from self._until_fault(before, piece, fed)
                        return
                    fed += len(piece) - len(d.unused_data)
                    self.used = fed
                    if out:
                        yield out
                    piece, d = (d.unused_data, None) if d.eof else (b"", d)
        self.cut = d is not None

    def _until_fault(self, d: zlib._Decompress, piece: bytes, fed: int) -> Iterator[bytes]:
        for k in range(len(piece)):
            try:
                out = d.decompress(piece[k:k + 1])
            except zlib.error:
                return
            if out:
                self.used = fed + k + 1
                yield out


def _bytes(text: str, start: int) -> Iterator[bytes]:
    """The bytes that characters stand for, as far as they do."""
    for k in range(start, len(text), 4 * PIECE):
        part = text[k:k + 4 * PIECE]
        wide = WIDE.search(part)
        yield part[:wide.start() if wide else len(part)].encode("latin-1")
        if wide:
            return


def _after(chunks: Iterable[bytes], skip: int) -> Iterator[bytes]:
    for chunk in chunks:
        if skip < len(chunk):
            yield chunk[skip:]
        skip = max(0, skip - len(chunk))


def _windows(chunks: Iterable[bytes]) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of overlapping windows."""
    held, place, new = bytearray(), 0, 0
    for chunk in chunks:
        held += chunk
        new += len(chunk)
        if len(held) >= WINDOW:
            yield place, bytes(held)
            place += len(held) - OVERLAP
            held, new = held[-OVERLAP:], 0
    if new:
        yield place, bytes(held)


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    text, lines = _unwrapped(layer.text)
    for m in BASE64.finditer(text):
        run = lines.span(m.start(), m.end())
        if not layer.touched(*run):
            continue
        end = run[1]
        while end < min(run[1] + 2, len(layer.text)) and layer.text[end] == "=":
            end += 1
        body = m[0].replace("-", "+").replace("_", "/")
        for offset in range(4):
            size = len(body) - offset
            size -= size % 4 == 1
            raw = base64.b64decode(body[offset:offset + size] + "=" * (-size % 4))
            if not (_worth_it(raw) or COMPRESSED.search(raw.decode("latin-1"))):
                continue

            def span(s: int, e: int, first: int = m.start() + offset, n: int = len(raw), end: int = end) -> tuple[int, int]:
                start, last = lines.span(first + s * 8 // 6, first - (-min(e, n) * 8 // 6))
                return start, end if e > n else last  # one more stands for the padding

            yield Layer(raw.decode("latin-1"), layer, span, "base64")


def _compressed_layers(layer: Layer, opened: list[int]) -> Iterator[Layer]:
    at = 0
    while m := COMPRESSED.search(layer.text, at):
        at = m.start() + 1
        if not layer.touched(m.start(), m.end()):
            continue
        how = "gzip" if m[0][0] == "\x1f" else "zlib"
        probe, out, size = Inflate(_bytes(layer.text, m.start())), bytearray(), 0
        for chunk in probe:
            size += len(chunk)
            if opened[0] + size > MAX_OPENED:
                raise Bomb(*layer.span(m.start(), m.start() + max(1, probe.used)), f"{layer.path}+{how}")
            if size <= WINDOW:
                out += chunk
        if not probe.used:
            continue
        span = (m.start(), m.start() + probe.used + (layer.padded and m.start() + probe.used == len(layer.text)))

        def source(cut: bool = probe.cut, start: int = m.start()) -> Iterable[bytes]:
            return Inflate(_after(layer.source(), start) if cut and layer.source else _bytes(layer.text, start))

        longer = size > WINDOW or probe.cut and layer.source is not None
        for place, raw in _windows(source() if longer else [bytes(out)]):
            opened[0] += len(raw)
            inner = Layer(raw.decode("latin-1"), layer, lambda s, e, span=span: span, how, True,
                          source=lambda place=place, source=source: _after(source(), place))
            if opened[0] > MAX_OPENED or inner.depth > MAX_DEPTH:
                raise Bomb(*inner.span(0, 1), inner.path)
            if _worth_it(raw) or COMPRESSED.search(inner.text):
                yield inner
        if not probe.cut:
            at = max(at, span[1])


def regions(layer: Layer, opened: list[int]) -> Iterator[Layer]:
    """The layers directly inside a layer."""
    for sign, pattern, how in (("%", ONE_PERCENT, "url"), ("\\", ONE_ESCAPE, "unicode")):
        if sign in layer.text and pattern.search(layer.text):
            deep = layer.escapes >= ESCAPES
            out, shifts = _settled(layer.text) if deep else _replaced(layer.text, pattern)
            yield Layer(out, layer, shifts.span, "escapes" if deep else how, touched=shifts.touched)
            if deep:
                break
    yield from _base64_layers(layer)
    if layer.up:  # bytes, not the text itself
        yield from _compressed_layers(layer, opened)


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """Base findings (start, kind, end) and those of decoded layers (start, end, kind@encodings)."""
    base, deep, opened = scan(text), set(), [0]
    best = {(s, e, k): "" for s, k, e in base}  # the shortest way to each finding that has its own characters
    seen: set[bytes] = set()
    todo = [iter([Layer(text)])]
    while todo:
        try:
            layer = next(todo[-1], None)
        except Bomb as bomb:
            start, end, path = bomb.args
            deep.add((start, end, f"unopened@{path}"))
            todo.pop()
            continue
        if layer is None:
            todo.pop()
            continue
        if not layer.text:
            continue
        key = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest() + str(layer.span(0, 1)).encode()
        if key in seen:
            continue
        seen.add(key)
        for s, k, e in scan(layer.text) if layer.up else ():
            if not layer.touched(s, e):
                continue
            place = (*layer.span(s, e), k)
            if layer.whole:
                deep.add((*place[:2], f"{KINDS[k]}@{layer.path}"))
            else:
                best[place] = min(best.get(place, layer.path), layer.path, key=lambda p: (len(p), p))
        todo.append(regions(layer, opened))
    return base, sorted(deep | {(s, e, f"{KINDS[k]}@{path}") for (s, e, k), path in best.items() if path})


def _worth_it(raw: bytes) -> bool:
    """Whether anything of a text can match: a few fast passes over the bytes."""
    lower = raw.lower()
    return (any(n in lower for n in _NAMES) or b"AKIA" in raw or b"%" in raw or b"\\" in raw
            or b"x" * 24 in raw.translate(_HEX_MAP) or b"x" * LEAST_BASE64 in _LINE_END.sub(b"", raw).translate(_BASE64_MAP))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_spans and spans (``kind:start:end``, by start).

    Findings of decoded layers are named ``kind@encoding>encoding`` and span the encoded characters.
    """
    def make() -> Callable[[bytes], tuple]:
        def each(raw: bytes) -> tuple:
            if not _worth_it(raw):
                return 0, 0, 0, "", ""
            base, deep = find(raw.decode())
            own = [(s, k, f"{KINDS[k]}:{s}:{e}") for s, k, e in base]
            every = sorted([*own, *((s, len(KINDS), f"{kind}:{s}:{e}") for s, e, kind in deep)])
            n = [sum(k == kind for _, kind, _ in base) for k in range(3)]
            return (*n, ",".join(x for *_, x in own), ",".join(x for *_, x in every))

        return each

    return per_text(docs, make, "n_assign long, n_access long, n_hex long, base_spans string, spans string", id_col, text_col)
