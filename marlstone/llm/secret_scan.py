"""Operator 3: secret scans with a recursive decoding worklist.

Every layer of a text is scanned with the same three rules. A layer's children are: the layer
with its percent escapes decoded, the layer with its Unicode escapes decoded, and each base64 run
decoded (and decompressed where the bytes are gzip, zlib, bzip2, xz or zstd). A run goes on over line breaks, and is decoded in
all four phases, so that what stands before a blob does not hide it; compressed streams are looked for at every byte. Children go on
the worklist until nothing new appears; a layer whose content was seen at the same place of the document
is not entered again, which ends cycles. Escapes nested deeper than ``MAX_STEPS`` (an escape of an escape of ...) are resolved to their end in one pass,
so a text of n such levels makes a bounded number of layers and not n. Each character of a layer carries the range of the
document that it comes from, so a match in any layer is reported as a span of the document.

Defined results: a null text is empty and has no spans; bytes that are not UTF-8 stand in a layer as characters that no rule
matches, and decoded bytes without ``MIN_TEXT`` readable characters in a row, fewer than any secret has, are no layer unless all of them are text; all members and
streams that follow each other are read, and a decompressed layer has no bound but is held in windows of MAX_LAYER bytes, cut where no secret can be; only
an unbroken run of half a window is cut within, with OVERLAP characters in both windows; a damaged stream gives what comes before the damage; repeated rows give repeated rows; other columns are ignored.
"""

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
from collections import deque
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table
from . import common

KINDS = ("assign", "access", "hex")
#: Bytes of a decompressed layer that are held at a time.
MAX_LAYER = 64 << 20
MIN_BASE64 = 16
#: Bytes that a decompressor takes and gives at a time.
STEP = 1 << 18
#: Characters that two windows of a layer share where they have to be cut within one unbroken run.
OVERLAP = 1 << 20
#: Compressed streams directly in each other that are opened; one that holds itself has no end.
MAX_NESTED = 64
#: Layers of escapes on escapes that are scanned one by one.
MAX_STEPS = 8

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a greedy run of 20 characters or more, as AKIA[A-Z0-9]+ with the length test
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # a whole run of 24 characters or more
_WORDS = ("passw", "secret", "token", "api")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: Readable characters in a row of a layer that is not text as a whole; the shortest secret is token=abcdef.
MIN_TEXT = 12
_READABLE = re.compile(rf"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f\udc80-\udcff]{{{MIN_TEXT},}}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]+(?:[ \t]*(?:\r\n|\n|\r)[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_APART = re.compile(r"""[^A-Za-z0-9+/_.=\-"' :%\\{}&#;\t\r\n]""")
_ESCAPED = re.compile("[\udc80-\udcff]")
_BREAK = re.compile(r"[ \t\r\n]+")
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_BASE64},}}={{0,2}}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rules' matches in one text, in no order."""
    out = []
    if ("=" in text or ":" in text) and any(w in (low := text.lower()) for w in _WORDS):
        del low
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    if _long(text, 24):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def _long(text: str, n: int) -> bool:
    """Whether a run without white space has n characters or more."""
    return max(map(len, text.split()), default=0) >= n


class _Layer:
    """A decoded text; starts[i] and ends[i] give the document's range that character i comes from, or one range for all."""

    def __init__(self, text: str, starts: array | int, ends: array | int, depth: int, steps: int = 0):
        self.text, self.starts, self.ends, self.depth, self.steps = text, starts, ends, depth, steps

    def root(self, start: int, end: int) -> tuple[int, int]:
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return min(self.starts[start:end]), max(self.ends[start:end])


def _opened(head: bytes):
    """The decompressor for a stream that begins so; None where it is no compressed stream."""
    m = _MAGIC.match(head)
    if not m:
        return None
    if m[0][:1] in (b"\x1f", b"\x78"):
        return zlib.decompressobj(31 if m[0][:1] == b"\x1f" else 15)
    if m[0][:1] == b"B":
        return bz2.BZ2Decompressor()
    if m[0][:1] == b"\xfd":
        return lzma.LZMADecompressor()
    return _Zstd()


class _Zstd:
    """A zstd frame with the interface of the others."""

    def __init__(self):
        import zstandard

        self.stream, self.left = zstandard.ZstdDecompressor().decompressobj(), b""

    @property
    def eof(self) -> bool:
        return self.stream.eof

    @property
    def unused_data(self) -> bytes:
        return self.stream.unused_data + self.left

    def decompress(self, data: bytes) -> bytes:
        return self.stream.decompress(data)


def _stepped(stream, data: bytes) -> Iterator[bytes]:
    """What the stream makes of more data, at most about STEP bytes at a time."""
    if hasattr(stream, "needs_input"):  # bzip2, xz
        yield stream.decompress(data, STEP)
        while not stream.eof and not stream.needs_input:
            yield stream.decompress(b"", STEP)
    elif hasattr(stream, "flush") and hasattr(stream, "copy"):  # gzip, zlib
        more = True
        while more:
            out = stream.decompress(data, STEP)
            data = stream.unconsumed_tail
            more = not stream.eof and (bool(data) or len(out) == STEP)
            yield out
    else:  # zstd has no bound on its output, but a block of 3 bytes or more makes at most 128 KB
        for i in range(0, len(data), 64):
            if stream.eof:
                stream.left = data[i:]
                break
            yield stream.decompress(data[i : i + 64])


class _Inflated:
    """The output of all members and streams that follow each other in ``chunks``, in pieces; ``used`` counts the bytes of those that were read.
    A damaged stream gives what comes before the damage."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.used = chunks, 0

    def __iter__(self) -> Iterator[bytes]:
        held = b""
        while True:
            while len(held) < 8 and (more := next(self.chunks, None)) is not None:
                held += more
            pad = len(held) - len(held.lstrip(b"\0")) if self.used else 0  # between members
            stream = _opened(held[pad:])
            if stream is None:
                return
            self.used += pad
            held = held[pad:]
            try:
                while not stream.eof:
                    if not held and not (held := next(self.chunks, b"")):
                        return
                    self.used += len(held)
                    yield from filter(None, _stepped(stream, held))
                    held = b""
            except (OSError, ValueError, EOFError, lzma.LZMAError, zlib.error):
                return
            except Exception as e:  # zstandard raises a class of its own
                if type(e).__name__ != "ZstdError":
                    raise
                return
            held = stream.unused_data
            self.used -= len(held)


def _cut(text: str) -> int:
    """Where the window after this one begins: after the last character that no rule, escape or run contains, so that what may belong together stays so;
    without one in the second half, OVERLAP characters are read again."""
    for lo in range(len(text) - 65_536, len(text) // 2 - 65_536, -65_536):
        last = None
        for last in _APART.finditer(text, max(lo, 0), lo + 65_536):
            pass
        if last:
            return last.end()
    return len(text) - min(OVERLAP, len(text) // 2)


def _windows(pieces: Iterator[bytes]) -> Iterator[str]:
    """The text of the pieces in windows of about MAX_LAYER bytes, each of them a layer."""
    decoder = codecs.getincrementaldecoder("utf-8")("surrogateescape")
    held, size = [], 0
    for x in pieces:
        held.append(decoder.decode(x))
        size += len(held[-1])
        if size >= MAX_LAYER:
            text = "".join(held)
            at = _cut(text)
            yield text
            held, size = [text[at:]], len(text) - at
    held.append(decoder.decode(b"", True))
    yield "".join(held)


def _kept(text: str) -> bool:
    """Whether a text, with one lone surrogate for each byte that is not UTF-8, is a layer."""
    if _READABLE.search(text):
        return True
    return bool(text) and not _ESCAPED.search(text) and 10 * sum(1 for c in text if c < " " and c not in "\t\n\r") <= len(text)


def _texts(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, length or 0 for the data itself, text) of the data and of the compressed streams in it, streams within streams too."""
    if _kept(text := data.decode("utf-8", "surrogateescape")):
        yield 0, 0, text
    done = 0
    for m in _MAGIC.finditer(data):
        if m.start() < done:
            continue  # a member that was read with the ones before it
        view = memoryview(data)[m.start() :]
        for depth in range(1, MAX_NESTED + 1):
            outer = _Inflated(bytes(view[i : i + STEP]) for i in range(0, len(view), STEP))
            stream = iter(outer)
            for _ in range(1, depth):
                stream = iter(_Inflated(stream))
            head = b""
            while len(head) < 8 and (more := next(stream, None)) is not None:
                head += more
            for text in _windows(chain([head], stream)):
                if _kept(text):
                    done = max(done, m.start() + outer.used)
                    yield m.start(), outer.used, text
            if not _MAGIC.match(head):
                break


def _pieces(layer: _Layer, found: Iterator[tuple[int, int, list[tuple[str, int, int]]]]) -> _Layer | None:
    """The layer with each found (start, end, [(character, start, end)]) replaced."""
    text, out, at = layer.text, [], 0
    starts, ends = array("I"), array("I")
    flat = isinstance(layer.starts, int)
    for a, b, chars in found:
        out.append(text[at:a])
        if not flat:
            starts += layer.starts[at:a]
            ends += layer.ends[at:a]
        for c, s, e in chars:
            out.append(c)
            if not flat:
                lo, hi = layer.root(s, e)
                starts.append(lo)
                ends.append(hi)
        at = b
    if at == 0 and not out:
        return None
    out.append(text[at:])
    if flat:
        return _Layer("".join(out), layer.starts, layer.ends, layer.depth + 1, layer.steps + 1)
    return _Layer("".join(out), starts + layer.starts[at:], ends + layer.ends[at:], layer.depth + 1, layer.steps + 1)


_TAIL = re.compile(r"(?:%[0-7][0-9A-Fa-f]|\\(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});)\Z")
_CLOSING = frozenset("0123456789abcdefABCDEF};")


def _resolved(layer: _Layer) -> _Layer | None:
    """The layer with its escapes, and those that they make, resolved from left to right to their end (percent escapes of ASCII only): what is written is
    looked at again with what stands before it, so the pass takes time in proportion to the text."""
    flat = isinstance(layer.starts, int)
    out: list[str] = []
    starts, ends = array("I"), array("I")
    changed = False
    for i, c in enumerate(layer.text):
        out.append(c)
        if not flat:
            starts.append(layer.starts[i])
            ends.append(layer.ends[i])
        while out[-1] in _CLOSING and (m := _TAIL.search("".join(out[-12:]))):
            code = int(m[0][1:], 16) if m[0][0] == "%" else int(m[6]) if m[6] else int(next(g for g in m.groups()[:5] if g), 16)
            if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
                break
            n = len(m[0])
            changed = True
            out[-n:] = [chr(code)]
            if not flat:
                lo, hi = min(starts[-n:]), max(ends[-n:])
                del starts[-n:], ends[-n:]
                starts.append(lo)
                ends.append(hi)
    if not changed:
        return None
    if flat:
        return _Layer("".join(out), layer.starts, layer.ends, layer.depth + 1)
    return _Layer("".join(out), starts, ends, layer.depth + 1)


def _percent(text: str):
    for m in _PERCENT.finditer(text):
        data = bytes.fromhex(m[0].replace("%", ""))
        chars, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    chars.append((data[i : i + n].decode("utf-8"), m.start() + 3 * i, m.start() + 3 * (i + n)))
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                chars += [(c, m.start() + 3 * i + k, m.start() + 3 * i + k + 1) for k, c in enumerate(m[0][3 * i : 3 * i + 3])]
                i += 1
        yield m.start(), m.end(), chars


def _escapes(text: str):
    for m in _ESCAPE.finditer(text):
        code = int(m[6]) if m[6] else int(next(g for g in m.groups()[:5] if g), 16)
        if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF:
            yield m.start(), m.end(), [(chr(code), m.start(), m.end())]


def _children(layer: _Layer) -> Iterator[_Layer]:
    text = layer.text
    whole = lambda: layer if isinstance(layer.starts, int) or layer.depth else _Layer(text, array("I", range(len(text))), array("I", range(1, len(text) + 1)), 0)
    deep = _resolved(layer) if layer.steps >= MAX_STEPS else None
    if deep:
        yield deep
    if not deep and "%" in text and _PERCENT.search(text) and (child := _pieces(whole(), _percent(text))):
        yield child
    if not deep and ("\\" in text or "&#" in text) and _ESCAPE.search(text) and (child := _pieces(whole(), _escapes(text))):
        yield child
    if _long(text, MIN_BASE64):
        for m in _BASE64.finditer(text):
            yield from _decoded(layer, m.start(), m.end(), m[0], None)
    if "\n" in text or "\r" in text:
        for m in _LINES.finditer(text):
            run = _BREAK.sub("", m[0])
            if len(run) >= MIN_BASE64:
                yield from _decoded(layer, m.start(), m.end(), run, m[0])


def _decoded(layer: _Layer, start: int, end: int, run: str, lines: str | None) -> Iterator[_Layer]:
    """Children of one base64 run from ``start`` to ``end`` of the layer, or of the run that the ``lines`` there make."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    places: list[int] | None = None

    def origin(a: int, b: int) -> tuple[int, int]:
        """The document's range of characters a to b of the run."""
        nonlocal places
        if lines is None:
            a, b = start + a, start + b
        else:
            if places is None:
                places = [start + i for i, c in enumerate(lines) if c not in " \t\r\n"]
            a, b = places[a], places[b - 1] + 1
        return layer.root(a, b) if layer.depth else (a, b)

    for phase in range(4):
        own = run[phase:]
        if len(own) % 4 == 1:
            own = own[:-1]
        try:
            data = base64.b64decode(own + "=" * (-len(own) % 4))
        except binascii.Error:
            continue
        for at, used, text in _texts(data):
            if lines is None and not phase and not at and (used == len(data) or not used and not _ESCAPED.search(text)):
                # All of the run is the blob.
                yield _Layer(text, *(layer.root(start, end) if layer.depth else (start, end)), layer.depth + 1)
            elif used:
                yield _Layer(text, *origin(phase + at * 4 // 3, min(phase + ((at + used) * 4 + 2) // 3, len(run))), layer.depth + 1)
            else:
                starts, ends, i = array("I"), array("I"), 0
                for c in text:
                    n = 1 if c < "\x80" or "\udc80" <= c <= "\udcff" else len(c.encode())
                    lo, hi = origin(phase + i * 4 // 3, min(phase + ((i + n) * 4 + 2) // 3, len(run)))
                    starts.append(lo)
                    ends.append(hi)
                    i += n
                yield _Layer(text, starts, ends, layer.depth + 1)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """(base spans, all spans, layers) of one document; spans are (start, kind number, end), sorted."""
    text = text or ""
    base = sorted(base_spans(text))
    spans = set(base)
    work = deque([_Layer(text, array("I"), array("I"), 0)])
    seen: set[tuple] = set()
    while work:
        layer = work.popleft()
        for child in _children(layer):
            place = (child.starts, child.ends) if isinstance(child.starts, int) else (child.starts[0], child.ends[-1])
            mark = (hashlib.blake2b(child.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *place)
            if mark in seen or child.text == layer.text:
                continue
            seen.add(mark)
            for a, kind, b in base_spans(child.text):
                lo, hi = child.root(a, b)
                spans.add((lo, kind, hi))
            work.append(child)
    return base, sorted(spans), len(seen)


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n: list[list[int]] = [[], [], []]
        sha, said, layers = [], [], []
        for x in b.column(1):
            base, spans, deep = scan(x.as_py())
            for k in range(3):
                n[k].append(sum(s[1] == k for s in base))
            sha.append(hashlib.sha256(_said(base).encode()).hexdigest())
            said.append(_said(spans))
            layers.append(deep)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(said, pa.string()), pa.array(layers, pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    common.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long")


def redact(text: str | None, mark: str = "[{}]") -> str | None:
    """The text with every span (overlapping ones joined) replaced by the mark with its kinds."""
    if not text:
        return text
    _, spans, _ = scan(text)
    out, at, k = [], 0, 0
    while k < len(spans):
        a, kinds, b = spans[k][0], [], spans[k][2]
        while k < len(spans) and spans[k][0] < b or not kinds:
            kinds.append(KINDS[spans[k][1]])
            b = max(b, spans[k][2])
            k += 1
        out += [text[at:a], mark.format("+".join(dict.fromkeys(kinds)))]
        at = b
    return "".join([*out, text[at:]])


def _redact_batches(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([redact(x.as_py()) for x in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return run


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with the secrets of the text column masked."""
    common.bound_batches(docs.sparkSession)
    return docs.mapInArrow(_redact_batches(docs.columns.index(text_col)), docs.schema)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
