"""Secret scans by a recursive decoding worklist.

A text is scanned for the base kinds. Then the text without its URL escapes, the text without its Unicode escapes, and
every stretch that reads as base64 or a compressed body are layers of their own, each scanned and unwrapped in turn until no new layer comes
(a layer's digest seen on its own path ends a cycle). Every character of a layer keeps the span of the whole text that
it comes from, so a find in any layer is a span of the text. A compressed body maps to the whole stretch it was in, and what is
in it needs no span a character.

Escapes of an escape's own sign inside each other (`NEST` deep or more) come off in one step, so that layers don't add up to the
square; the hex runs that the layers between would show, of the nest's digits and the text as it stands behind it, are found on
the way. Nothing else can begin in them: the other kinds hold no sign of an escape, and a run of base64 is read in all four
alignments from the layer before. Bodies are read in
parts of about `PART` bytes that end outside any run of an encoding; a run that doesn't end within `HOLD` bytes is cut there, and
what follows begins `LAP` bytes before.

Nulls read as empty texts. Repeated rows give repeated results, very long texts are scanned whole, and an empty table
gives an empty result. Only the id and text columns are read, so other columns may have any name."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm.batches import pieces, texts

# The kinds and their patterns, in the order that breaks ties.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

NEST = 16
# Where a deep nest may stand, and what an escape's sign needs behind it to stand for such a sign again.
NESTED = re.compile(r"[%\\](?:25|5[cC]|[uxU]\{?0*(?:25|5[cC])\}?){16}")
AGAIN = {"%": re.compile(r"25|5[cC]"), "\\": re.compile(r"(?:u00|x|U000000)(?:25|5[cC])|u\{0{0,4}(?:25|5[cC])\}")}
DIGITS = re.compile(r"[0-9a-f]+")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
PERCENT_ASCII = re.compile(r"(?:%(?:[2-6][0-9A-Fa-f]|7[0-9A-Ea-e]|0[9AaDd]))+")
ESCAPED = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\})")
# Both alphabets at once, as a run may hold the signs of either; its lines may be wrapped.
# Behind the first 16 signs nothing is given back, so that a run of any length costs no memory.
BASE64 = re.compile(r"[A-Za-z0-9+/_-](?:(?:\r?\n[ \t]*)?[A-Za-z0-9+/_-]){15}(?:[A-Za-z0-9+/_-]++|\r?\n[ \t]*[A-Za-z0-9+/_-])*+={0,2}")
STANDARD = bytes.maketrans(b"-_", b"+/")

BAD = re.compile("[\udc80-\udcff]")
# What a layer must hold for a base hit or a further encoding: the start of a kind, an escape, a run of base64.
TELLING = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uxU]|(?:[A-Za-z0-9+/_-][\r\n]*+){16}")

MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0")
PIECE, PART, OVERLAP = 1 << 20, 1 << 22, 1 << 16  # bytes of inflated bodies
HOLD, LAP = 1 << 23, 1 << 19
# The start of a compressed body in escapes, and runs of such bytes.
MAGICAL = re.compile(r"(?i:(?:%|\\x|\\u00)(?:8b|01|5e|9c|da|78|42|5a|68|fd))|x\^|BZh[1-9]|7zXZ")
URL_RUN, URL_BYTE = re.compile(r"(?:%[0-9A-Fa-f]{2}|[!-$&-~])+"), re.compile(r"%[0-9A-Fa-f]{2}|[!-~]")
SHORT = {"n": "\n", "r": "\r", "t": "\t", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\\": "\\", "'": "'", '"': '"'}
X_BYTE = re.compile(r"""\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\[nrtabfv0\\'"]|[ -~]""")
X_ESCAPE = re.compile(r"""\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\[nrtabfv0\\'"]""")
X_RUN = re.compile(r"""[ -~]+""")

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """The base spans of one layer, in code points, each kind leftmost and without overlap."""
    found, low = [], text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


Where = tuple  # of a layer's characters: arrays (starts, ends), or two numbers where all have one span


class Layer:
    """A text and, for each of its characters, the span of the whole text behind it; without `where` it is that text."""

    __slots__ = ("text", "where", "path")

    def __init__(self, text: str, where: Where | None, path: frozenset[bytes]):
        self.text, self.where, self.path = text, where, path

    @property
    def flat(self) -> bool:
        return self.where is not None and isinstance(self.where[0], int)

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.where is None:
            return start, end
        if self.flat:
            return self.where
        return int(self.where[0][start:end].min()), int(self.where[1][start:end].max())


def _spread(data: bytes, where: Where) -> tuple[str, Where] | None:
    """UTF-8 bytes with a span each, as text with a span a character; bytes that aren't UTF-8 read as U+FFFD, one each.
    None where nothing in it could be found or decoded further."""
    if not TELLING.search(data):
        return None
    # A bad byte becomes one surrogate, so that characters and bytes stay in step.
    text = data.decode("utf-8", "surrogateescape")
    if not isinstance(where[0], int) and not text.isascii():
        sizes = np.fromiter((1 if "\udc80" <= c <= "\udcff" else len(c.encode()) for c in text), np.int64, len(text))
        past = np.cumsum(sizes)
        where = where[0][past - sizes], where[1][past - 1]
    return BAD.sub("\ufffd", text), where


def inflate(data: bytes, used: list[int]) -> Iterator[bytes]:
    """The output of all gzip, zlib, bzip2 and xz members from the first byte on, in pieces, up to a fault or other bytes.
    used[0] becomes the end of the last whole member, or of the bytes where the last one isn't whole."""
    rest = data
    while m := MAGIC.match(rest):
        zipped = m[0][:1] in b"\x1f\x78"
        tool = zlib.decompressobj(47) if zipped else bz2.BZ2Decompressor() if m[0][:1] == b"B" else lzma.LZMADecompressor()
        used[0], left = len(data), rest
        try:
            while not tool.eof:
                piece = tool.decompress(left, PIECE)
                left = tool.unconsumed_tail if zipped else b""
                if piece:
                    yield piece
                elif not left and not tool.eof and (zipped or tool.needs_input):
                    return
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return
        rest = tool.unused_data.lstrip(b"\0")
        used[0] = len(data) - len(rest)


def _joined(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces joined to parts that end outside any run of an encoding, and overlap by `OVERLAP`; a run beyond `HOLD` is cut."""
    held = bytearray()
    for piece in pieces:
        held += piece
        if len(held) < PART:
            continue
        if (at := max(piece.rfind(x) for x in (b" ", b",", b'"', b"}", b";", b"\0"))) >= 0:
            at += len(held) - len(piece)
            yield bytes(held[:at])
            del held[: max(0, at - OVERLAP)]
        elif len(held) >= HOLD:
            yield bytes(held)
            del held[:-LAP]
    if held:
        yield bytes(held)


def _rewritten(layer: Layer, found) -> tuple[str, Where] | None:
    """The whole layer with each (start, end, text, starts, ends) of `found`, in order, put in; None where there is none.
    A name and its value may stand on both sides of an escape, so what is between the escapes stays."""
    parts, starts, ends, last, flat = [], [], [], 0, layer.flat

    def keep(stop: int) -> None:
        if stop > last:
            parts.append(layer.text[last:stop])
            if not flat:
                starts.append(np.arange(last, stop) if layer.where is None else layer.where[0][last:stop])
                ends.append(np.arange(last, stop) + 1 if layer.where is None else layer.where[1][last:stop])

    for a, b, text, first, past in found:
        keep(a)
        parts.append(text)
        starts.append(first)
        ends.append(past)
        last = b
    if not last:
        return None
    keep(len(layer.text))
    return "".join(parts), layer.where if flat else (np.concatenate(starts), np.concatenate(ends))


def _peeled(layer: Layer, seen: set[Span]):
    """Deep nests with one sign left of each; the hex runs that its layers would show go to `seen`."""
    text, at = layer.text, 0
    while m := NESTED.search(text, at):
        sign, place, deep, end, runs = m[0][0], m.start() + 1, 0, 0, []
        while step := AGAIN[sign].match(text, place):
            sign = "%" if "25" in step[0] else "\\"
            place, deep = step.end(), deep + 1
            end = end if place < end else d.end() if (d := DIGITS.match(text, place)) else 0
            if end - place >= 24:
                runs.append(("hex", place, end))
        if deep < NEST:
            at = m.start() + 1
            continue
        seen.update((kind, *layer.span(x, y)) for kind, x, y in runs)
        a, b = layer.span(m.start(), place)
        yield m.start(), place, sign, np.array([a]), np.array([b])
        at = place


def _url(layer: Layer):
    """Runs of URL escapes as readable UTF-8; where a run isn't, its printable ASCII alone. Others stay as they are."""

    def read(a: int, b: int):
        data = bytes.fromhex(layer.text[a:b].replace("%", ""))
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            return None
        if layer.flat:
            return text, None, None
        spans = [layer.span(i, i + 3) for i in range(a, b, 3)]
        lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        tail = np.append(lead[1:], len(data)) - 1
        return text, np.array([x for x, _ in spans])[lead], np.array([y for _, y in spans])[tail]

    for m in PERCENT.finditer(layer.text):
        if out := read(*m.span()):
            yield (*m.span(), *out)
        else:
            for part in PERCENT_ASCII.finditer(layer.text, *m.span()):
                yield (*part.span(), *read(*part.span()))


def _unicode(layer: Layer):
    for m in ESCAPED.finditer(layer.text):
        value = int(re.sub(r"[^0-9A-Fa-f]", "", m[0][2:]), 16)
        if 0xD800 <= value < 0xE000 or value > 0x10FFFF:
            value = 0xFFFD
        a, b = layer.span(*m.span())
        yield (*m.span(), chr(value), np.array([a]), np.array([b]))


def _read(layer: Layer, data: bytes, first: np.ndarray | None, last: np.ndarray | None, end: int, text: bool = True):
    """Layers of bytes that come from the layer's characters first .. last: as text, and as compressed bodies, which may
    begin behind other bytes. A body that uses up the bytes ends at character `end`. Flat layers need no places."""
    past = 0
    for m in MAGIC.finditer(data):
        if m.start() < past:
            continue
        used = [0]
        # Where a body ends is known only behind its last part, and all parts map to the whole stretch.
        size = sum(map(len, inflate(data[m.start() :], used)))
        if not size:
            continue
        past = m.start() + used[0]
        where = layer.where if layer.flat else layer.span(int(first[m.start()]), end + 1 if past == len(data) else int(last[past - 1]) + 1)
        for body in _joined(inflate(data[m.start() :], used)):
            if out := _spread(body, where):
                yield out
    if not text:
        return
    where = layer.where if layer.flat else (first, last + 1) if layer.where is None else (layer.where[0][first], layer.where[1][last])
    if out := _spread(data, where):
        yield out


def _escaped(layer: Layer):
    """Compressed bodies in URL, \\x or \\u00 escapes, whose other bytes stand as themselves."""
    for run, token in (URL_RUN, URL_BYTE), (X_RUN, X_BYTE):
        for m in run.finditer(layer.text):
            if not MAGICAL.search(m[0]):
                continue
            if layer.flat:
                data = unquote_to_bytes(m[0]) if token is URL_BYTE else X_ESCAPE.sub(lambda t: chr(_byte(t[0])), m[0]).encode("latin-1")
                yield from _read(layer, data, None, None, 0, text=False)
                if token is URL_BYTE and "+" in m[0]:
                    yield from _read(layer, unquote_to_bytes(m[0].replace("+", " ")), None, None, 0, text=False)
                continue
            found = [(t.start(), t.end() - 1, _byte(t[0])) for t in token.finditer(layer.text, *m.span())]
            first, last, values = (np.array(x, np.int64) for x in zip(*found))
            data = values.astype(np.uint8).tobytes()
            yield from _read(layer, data, first, last, m.end() - 1, text=False)
            if token is URL_BYTE and "+" in m[0]:  # a space in forms
                plus = np.array([layer.text[i] == "+" for i in first])
                yield from _read(layer, np.where(plus, 32, values).astype(np.uint8).tobytes(), first, last, m.end() - 1, text=False)


def _byte(token: str) -> int:
    if token[0] == "%" and len(token) == 3:
        return int(token[1:], 16)
    if token[0] == "\\" and len(token) > 1:
        return int(token[2:], 16) if token[1] in "xu" else ord(SHORT[token[1]])
    return ord(token)


def unwrap(layer: Layer, seen: set[Span]):
    """(text, where) of each layer below: the whole text without its URL or Unicode escapes, and each stretch that
    base64 or a compressed body reads; spans are of the whole text. Deep nests of escapes come off first."""
    text = layer.text
    if NESTED.search(text) and (out := _rewritten(layer, _peeled(layer, seen))):
        yield out
    else:
        if "%" in text and (out := _rewritten(layer, _url(layer))):
            yield out
        if "\\" in text and (out := _rewritten(layer, _unicode(layer))):
            yield out
    if MAGICAL.search(text):
        yield from _escaped(layer)
    for m in BASE64.finditer(text):
        run = np.frombuffer(m[0].encode().translate(STANDARD).rstrip(b"="), np.uint8)
        place = np.flatnonzero(run > 32)  # without line breaks and indents
        run, place = (run[place], place + m.start()) if len(place) < len(run) or not layer.flat else (run, None)
        # The run may begin behind other signs of its alphabet, such as a path, so that each alignment may be its own.
        for skip in range(4):
            some = run[skip:].tobytes()
            some = some[: len(some) - (len(some) % 4 == 1)]
            data = base64.b64decode(some + b"=" * (-len(some) % 4))
            if layer.flat:
                yield from _read(layer, data, None, None, 0)
                continue
            # Byte k of the body comes from the signs 4k/3 .. of the run.
            k = np.arange(len(data))
            first, last = place[skip + k * 4 // 3], place[np.minimum(skip + (k * 8 + 7) // 6, len(place) - 1)]
            yield from _read(layer, data, first, last, m.end() - 1)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a whole text, each sorted by start, then kind; all spans are distinct."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = scan(text)
    seen = set(base)
    if not text:
        return [], []
    done: set[bytes] = set()  # layers by text and spans: escapes of two codings come off in either order
    top = Layer(text, None, frozenset([hashlib.blake2b(text.encode(errors="replace"), digest_size=16).digest()]))
    work = [(top, unwrap(top, seen))]  # depth first, so that one part of a body is held at a time
    while work:
        layer, below = work[-1]
        if (got := next(below, None)) is None:
            work.pop()
            continue
        inner, where = got
        mark = hashlib.blake2b(inner.encode(errors="replace"), digest_size=16).digest()
        spans = repr(where).encode() if isinstance(where[0], int) else where[0].tobytes() + where[1].tobytes()
        whole = hashlib.blake2b(mark + spans, digest_size=16).digest()
        if mark in layer.path or whole in done:
            continue
        done.add(whole)
        under = Layer(inner, where, layer.path | {mark})
        seen.update((kind, *under.span(a, b)) for kind, a, b in scan(inner))
        work.append((under, unwrap(under, seen)))
    return sorted(base, key=order), sorted(seen, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with every stretch that the spans cover replaced by `mask`."""
    out, last = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], mask]
        last = max(last, b)
    return "".join([*out, text[last:]])


DIGEST = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def digest(text: str) -> tuple:
    base, every = find(text)
    kinds = [k for k, _, _ in base]
    return (*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in DIGEST.split(", "))]
    types = [pa.int64()] * 3 + [pa.string()] * 2

    def run(batches):
        for piece in pieces(batches):
            columns = list(zip(*map(digest, texts(piece))))
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {DIGEST}")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with secrets masked in `text_col` (null stays null); its other columns go on as they are."""
    place = docs.columns.index(text_col)

    def run(batches):
        for piece in pieces(batches, text_col):
            clean = [x if x is None else redact(x, find(x)[1]) for x in piece.column(place).to_pylist()]
            yield piece.set_column(place, piece.schema.field(place), pa.array(clean, piece.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
