"""GIF media columns: encode samples, decode any GIF87a/89a stream, and describe timed frames.

Decoding walks the blocks of the format, replays each image's LZW code stream, applies its palette, and draws it on
the canvas under the disposal and transparency rules. The payload form (`encode_samples`) keeps bytes losslessly: one
byte is one palette index of a 64-pixel-wide grey image; a payload of more rows than a frame has goes on in further
frames, each shown for a tenth of a second. The widths of LZW codes follow from their place after a clear code alone, so that NumPy packs
and unpacks the bits and only the string table itself is kept by Python.

Null texts read as empty; a payload is padded with zero bytes to a positive multiple of 64. Equal texts give equal
bytes; repeated rows give repeated results; very long texts are one piece each, in frames of 32 KB. In `frames_of` null media
gives no rows; of media with a fault the sound frames before it are rows, and the fault is one with its `error`. An empty
table gives an empty result. Only the id and the payload column are read, so other columns may have any name."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm.batches import pieces, raw

WIDTH = 64
MAX_ROWS = 65535
FRAME_ROWS = 512  # of a stored payload: frames of 32 KB, shown one after the other
PIXELS = 1 << 26  # of a canvas, 256 MB of memory; larger media are reported, not decoded
GREY = bytes(x for i in range(256) for x in (i, i, i))


@dataclass
class Frame:
    index: int
    at_ms: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    transparent: int  # palette index, or -1
    canvas: np.ndarray  # uint32 pixels, R in the low byte and A in the high one; shape (screen height, screen width)
    samples: np.ndarray  # this image's palette indices, row by row


@functools.lru_cache
def _widths(bits: int) -> np.ndarray:
    """Bits of the n-th code after a clear code: the reader's table grows by one entry a code, from the second on."""
    table = (1 << bits) + 2 + np.maximum(0, np.arange(8192) - 1)
    return np.minimum(12, np.floor(np.log2(table)).astype(np.int64) + 1)


def _codes(samples: bytes, bits: int) -> list[list[int]]:
    """The greedy LZW codes of the samples, a list for each filling of the table."""
    clear, runs, known = 1 << bits, [], {}
    steps = iter(samples)
    now = next(steps, None)
    while now is not None:
        known, run, new = {}, [], clear + 2
        get, put = known.get, run.append
        runs.append(run)
        for sample in steps:
            key = now << 8 | sample
            if (code := get(key)) is not None:
                now = code
                continue
            put(now)
            now = sample
            if new == 4096:
                break
            known[key] = new
            new += 1
        else:
            put(now)
            now = None
    return runs or [[]]


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """A compressing LZW stream: a clear code first and whenever the table is full."""
    clear, width = 1 << bits, _widths(bits)
    codes, sizes, lead = [], [], bits + 1
    for run in _codes(samples, bits):
        codes += [clear, *run]
        sizes += [[lead], width[: len(run)]]
        lead = width[len(run)]
    codes.append(clear + 1)
    sizes.append([lead])
    ends = np.cumsum(np.concatenate(sizes))
    starts = np.concatenate(([0], ends[:-1]))
    shifted = np.array(codes, np.uint32) << (starts & 7).astype(np.uint32)
    out = np.zeros((int(ends[-1]) >> 3) + 4, np.uint8)
    at = starts >> 3
    for k in range(3):
        some = (shifted >> np.uint32(8 * k) & np.uint32(255)).astype(np.uint8)
        if bits >= 7:  # codes of 8 bits or more: each begins in a byte of its own
            out[at + k] |= some
        else:
            np.bitwise_or.at(out, at + k, some)
    return out[: (int(ends[-1]) + 7) >> 3].tobytes()


def _unpack(data: bytes, bits: int) -> Iterator[tuple[list[int], bool]]:
    """Codes in order, up to the end code or the last whole one, with whether a clear or end code follows them."""
    width, clear = _widths(bits), 1 << bits
    buffer = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total, bit, run = 8 * len(data), 0, 0
    while bit < total:
        sizes = width[run : run + 4096] if run < 4096 else np.full(4096, 12, np.int64)
        ends = bit + np.cumsum(sizes)
        n = int(np.searchsorted(ends, total, side="right"))
        if not n:
            return
        starts, sizes = ends[:n] - sizes[:n], sizes[:n]
        at = starts >> 3
        codes = (buffer[at] | buffer[at + 1] << 8 | buffer[at + 2] << 16) >> (starts & 7).astype(np.uint32) & ((1 << sizes) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if len(stops):
            k = int(stops[0])
            yield codes[:k].tolist(), True
            if codes[k] == clear + 1:
                return
            bit, run = int(ends[k]), 0
        else:
            yield codes.tolist(), False
            bit, run = int(ends[n - 1]), run + n


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """The samples of any LZW code stream with minimum code size `bits`, at most `most` of them."""
    roots = [bytes([i]) for i in range(1 << bits)] + [b"", b""]
    table, last, out = roots[:], b"", []
    have = len(table)
    for codes, ended in _unpack(data, bits):
        add, put = table.append, out.append
        for code in codes:
            if code < have:
                piece = table[code]
                if have < 4096 and last:
                    add(last + piece[:1])
                    have += 1
            elif code == have and last and have < 4096:
                piece = last + last[:1]
                add(piece)
                have += 1
            else:
                raise ValueError(f"LZW code {code} is beyond the table")
            put(piece)
            last = piece
        if ended:
            table, last = roots[:], b""
            have = len(table)
            out = [b"".join(out)]
            if len(out[0]) >= most:
                break
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    """Sub-blocks of up to 255 bytes and the empty one that ends them."""
    full = len(data) // 255
    body = np.empty((full, 256), np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
    rest = data[full * 255 :]
    return body.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode_samples(payload: bytes, delay_cs: int = 10, rows: int = MAX_ROWS) -> bytes:
    """A GIF whose frames hold `payload` (a positive multiple of 64 bytes), byte for byte."""
    step = rows * WIDTH
    parts = [payload[i : i + step] for i in range(0, len(payload), step)]
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, len(parts[0]) // WIDTH, 0xF7, 0, 0), GREY]
    for part in parts:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0, 8))
        out.append(_blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


def _colours(table: bytes) -> np.ndarray:
    """Palette as uint32 pixels; indices beyond the table are opaque black."""
    out = np.full(256, 0xFF000000, np.uint32)
    rgb = np.frombuffer(table, np.uint8).reshape(-1, 3).astype(np.uint32)
    out[: len(rgb)] = rgb[:, 0] | rgb[:, 1] << 8 | rgb[:, 2] << 16 | np.uint32(0xFF000000)
    return out


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while n := data[at]:
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(out), at + 1


def _rows_of(height: int) -> np.ndarray:
    """The order in which an interlaced image's rows come."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> Iterator[Frame]:
    """The frames as shown, in order. The canvas starts transparent; each yielded canvas is the reader's own copy. A canvas of more than
    `PIXELS`, a code stream that ends before its image is full, and any other fault are a ValueError, IndexError or struct.error."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, _colours(b"")
    if flags & 0x80:
        size = 3 << (flags & 7) + 1
        shared = _colours(data[at : at + size])
        at += size
    canvas = None  # made for the first image, so that a screen's stated size alone costs nothing
    delay, disposal, clear_index, index, clock = 0, 0, -1, 0, 0
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                clear_index = body[3] if body[0] & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind:#x}")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if local & 0x80:
            size = 3 << (local & 7) + 1
            palette = _colours(data[at : at + size])
            at += size
        bits = data[at]
        codes, at = _sub_blocks(data, at + 1)
        grown = (max(wide, left + w), max(high, top + h))
        if grown[0] * grown[1] > PIXELS:
            raise ValueError(f"{grown[0]} x {grown[1]} pixels are more than {PIXELS}")
        if canvas is None:
            canvas = np.zeros((high, wide), np.uint32)
        if not 2 <= bits <= 8:
            raise ValueError(f"code size {bits}")
        samples = np.frombuffer(lzw_decode(codes, bits, w * h), np.uint8)
        if len(samples) < w * h:
            raise ValueError(f"cut code stream: {len(samples)} of {w * h} samples")
        grid = samples.reshape(h, w)
        if local & 0x40 and h:
            plain = np.empty_like(grid)
            plain[_rows_of(h)] = grid
            grid = plain
        if top + h > canvas.shape[0] or left + w > canvas.shape[1]:  # images may exceed the stated screen
            canvas = np.pad(canvas, ((0, max(0, top + h - canvas.shape[0])), (0, max(0, left + w - canvas.shape[1]))))
        before = canvas.copy() if disposal == 3 else None
        spot = canvas[top : top + h, left : left + w]
        colours = palette[grid]
        if clear_index >= 0:
            np.copyto(spot, colours, where=grid != clear_index)
        else:
            spot[:] = colours
        yield Frame(index, clock * 10, delay * 10, left, top, w, h, disposal, clear_index, canvas.copy(), grid.reshape(-1))
        if disposal == 2:
            spot[:] = 0
        elif before is not None:
            canvas = before
        clock += delay
        index += 1
        delay, disposal, clear_index = 0, 0, -1


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of opaque pixels in 8 x 8 x 8 bins of red, green and blue; the last count, bin 512, is of transparent ones."""
    counts, flat = np.zeros(513, np.int64), canvas.reshape(-1)
    for at in range(0, len(flat), 1 << 16):  # in pieces that stay in the cache
        part = flat[at : at + (1 << 16)]
        bins = (part >> 5 & 7) << 6 | (part >> 13 & 7) << 3 | (part >> 21 & 7)
        counts += np.bincount(np.where(part >> 24, bins, 512), minlength=513)
    return counts


def sparse(counts: np.ndarray) -> str:
    return ",".join(f"{i}:{counts[i]}" for i in np.flatnonzero(counts))


def payload_of(text: bytes) -> bytes:
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_ms long, frame_features string"


def digest(text: bytes) -> tuple:
    """Stores the payload of a text as a GIF of timed frames, reads the stored bytes back and describes what came back: the payload, the
    colour histogram of all frames, how many there are and how long they last, and each one's time and commonest colour."""
    media = encode_samples(payload_of(text), rows=FRAME_ROWS)
    back, counts, shows, ends = [], np.zeros(513, np.int64), [], 0
    for frame in decode(media):
        shown = frame.canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width]
        back.append((shown & 255).astype(np.uint8).tobytes())  # of a grey palette any channel is the sample
        own = histogram(shown)
        counts += own
        shows.append(f"{frame.at_ms}:{int(own.argmax())}")
        ends = frame.at_ms + frame.delay_ms
    payload = b"".join(back)
    return (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), sparse(counts), len(back), ends, ",".join(shows))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, ..., feature): `digest` of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, {DIGEST}"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", *(x.split()[0] for x in DIGEST.split(", "))]

    def run(batches):
        for piece in pieces(batches):
            columns = list(zip(*map(digest, raw(piece))))
            yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


FRAMES = "frame int, at_ms long, delay_ms long, left int, top int, width int, height int, disposal int, transparent int, histogram string, canvas_sha256 string, error string"


def frames_of(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row a frame of each GIF in `media_col`: its time, place, disposal and the colour histogram of the canvas shown."""
    kind = media.schema[id_col].dataType.simpleString()

    def rows(data: bytes):
        try:
            for f in decode(data):
                yield (f.index, f.at_ms, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, f.transparent, sparse(histogram(f.canvas)), hashlib.sha256(f.canvas.astype("<u4").tobytes()).hexdigest(), None)
        except (ValueError, IndexError, struct.error) as error:  # a fault of the media; others are faults of the program
            yield (*[None] * 11, f"{type(error).__name__}: {error}")

    def run(batches):
        for frame in pieces(batches, "media"):
            for key, data in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                if data is not None:
                    table = pa.Table.from_pylist([dict(zip(("id", *names), (key, *r))) for r in rows(data)], schema=arrow(frame.schema.field(0).type))
                    yield from table.to_batches()

    names = [x.split()[0] for x in FRAMES.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}

    def arrow(first):
        return pa.schema([("id", first), *((n, types[x.split()[1]]) for n, x in zip(names, FRAMES.split(", ")))])

    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, {FRAMES}")
