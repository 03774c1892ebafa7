"""Progressive JPEG media columns, decoded and encoded in numpy.

The decoder accumulates the scans of a progressive image (spectral selection and successive approximation, first passes
and refinements, restart intervals) into coefficient arrays, inverse-transforms them, repeats chroma samples up to full
resolution and gives an RGB tensor. A scan whose tables hold one symbol each has fields of one width, and is read as a
bit matrix; any other scan is read bit by bit.

The carrier stores a byte string without loss as the format's own unit, the quantized coefficient: 192 bytes are the 64
coefficients of a luma, a blue and a red block. AC coefficients are 256 plus the byte. DC coefficients alternate between
512 plus the byte and minus the byte, so that their differences, too, all have one bit length, and Huffman tables of one
symbol do for every scan. The DC and AC bits are spread over eleven scans: DC, two AC bands a component, and refinements.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK = 64
UNIT = 3 * BLOCK
#: Blocks whose bits are laid out at once; a multiple of 8, so that pieces end on whole bytes.
PIECE = 4096
#: Most blocks in a row of a carrier image.
ROW = 1024
NOTE = b"tracewright payload "
#: First AC band of a carrier's components; the second one is the rest.
BAND = 5


def _zigzag() -> np.ndarray:
    """Natural position of each zigzag index."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else -x[0]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_K = np.arange(8)
#: Orthonormal 8-point cosine basis, a row per frequency.
DCT = (np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)[:, None]).astype(np.float32)


# ---------------------------------------------------------------------------------------------- carrier


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest bits of integers, highest first, on a new last axis."""
    return (values[..., None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8)


def _pack(pieces: Iterator[np.ndarray]) -> bytes:
    """Bits of a scan as entropy-coded bytes: ones fill the last byte, and a zero byte follows each 255."""
    out = []
    for bits in pieces:
        bits = bits.reshape(-1)
        if len(bits) % 8:
            bits = np.r_[bits, np.ones(-len(bits) % 8, dtype=np.uint8)]
        out.append(np.packbits(bits).tobytes())
    return b"".join(out).replace(b"\xff", b"\xff\x00")


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(parts: list[tuple[int, int]], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    """parts: component id and table byte."""
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes(p) for p in parts) + bytes([first, last, high << 4 | low])) + data


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of 192 bytes."""
    return data + b" " * (UNIT - len(data) if not data else -len(data) % UNIT)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that carries a payload of a positive multiple of 192 bytes as its coefficients."""
    units = len(payload) // UNIT
    if not units or len(payload) % UNIT:
        raise ValueError("the payload isn't a positive multiple of 192 bytes")
    high = -(-units // ROW)
    wide = -(-units // high)
    raw = np.frombuffer(payload + b" " * (UNIT * (wide * high - units)), dtype=np.uint8).reshape(-1, 3, BLOCK)
    n = len(raw)
    odd = (np.arange(n) % 2 == 1)[:, None]
    dc = raw[:, :, 0].astype(np.int32)
    dc = np.where(odd, -dc, 512 + dc)
    top = dc >> 1
    diff = np.diff(top, axis=0, prepend=np.zeros((1, 3), dtype=np.int32))
    diff = np.where(diff < 0, diff + 511, diff)

    def pieces(make) -> Iterator[np.ndarray]:
        return (make(at, min(at + PIECE, n)) for at in range(0, n, PIECE))

    def band(c: int, a: int, b: int):
        def make(at: int, to: int) -> np.ndarray:
            bits = np.zeros((to - at, b - a + 1, 9), dtype=np.uint8)
            bits[:, :, 1:] = np.unpackbits((128 + (raw[at:to, c, a : b + 1] >> 1))[..., None], axis=2)
            return bits

        return make

    def refine(c: int):
        def make(at: int, to: int) -> np.ndarray:
            bits = raw[at:to, c] & 1
            bits[:, 0] = 0
            return bits

        return make

    size = struct.pack(">BHHB", 8, 8 * high, 8 * wide, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))
    out = [b"\xff\xd8", _segment(0xFE, NOTE + struct.pack(">Q", len(payload))), _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC2, size)]
    one = lambda kind, symbol: bytes([kind, 1] + [0] * 15 + [symbol])
    out.append(_segment(0xC4, one(0x00, 9) + one(0x10, 8) + one(0x11, 0)))
    out.append(_scan([(c, 0x00) for c in (1, 2, 3)], 0, 0, 0, 1, _pack(pieces(lambda a, b: _bits(diff[a:b], 10)))))
    for c in range(3):
        out.append(_scan([(c + 1, 0x00)], 1, BAND, 0, 1, _pack(pieces(band(c, 1, BAND)))))
        out.append(_scan([(c + 1, 0x00)], BAND + 1, 63, 0, 1, _pack(pieces(band(c, BAND + 1, 63)))))
    out.append(_scan([(c, 0x00) for c in (1, 2, 3)], 0, 0, 1, 0, _pack(pieces(lambda a, b: (dc[a:b] & 1).astype(np.uint8)))))
    for c in range(3):
        out.append(_scan([(c + 1, 0x01)], 1, 63, 1, 0, _pack(pieces(refine(c)))))
    return b"".join([*out, b"\xff\xd9"])


# ---------------------------------------------------------------------------------------------- decoder


@dataclass
class Component:
    """Sampling factors, quantization table number, blocks (rows, columns) with MCU padding and without, and coefficients in zigzag order."""

    h: int
    v: int
    tq: int
    padded: tuple[int, int] = (0, 0)
    blocks: tuple[int, int] = (0, 0)
    coefs: np.ndarray = field(default_factory=lambda: np.empty(0))


@dataclass
class Image:
    width: int
    height: int
    components: dict[int, Component]
    quant: dict[int, np.ndarray]
    note: bytes | None = None

    def rgb(self) -> np.ndarray:
        """Height by width by 3 (or the only component thrice), uint8."""
        hm, vm = (max(getattr(c, k) for c in self.components.values()) for k in "hv")
        planes = []
        for c in self.components.values():
            rows, cols = c.padded
            f = np.zeros((rows * cols, BLOCK), dtype=np.float32)
            f[:, ZIGZAG] = c.coefs.reshape(-1, BLOCK) * self.quant[c.tq].astype(np.float32)
            f = f.reshape(-1, 8, 8)
            s = np.matmul(np.matmul(DCT.T, f), DCT) + 128
            plane = s.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
            if hm != c.h or vm != c.v:
                plane = plane.repeat(vm // c.v, axis=0).repeat(hm // c.h, axis=1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) < 3:
            return np.repeat(np.clip(np.rint(planes[0]), 0, 255).astype(np.uint8)[..., None], 3, axis=2)
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        out = np.empty((*y.shape, 3), dtype=np.uint8)
        for i, x in enumerate((y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b)):
            out[..., i] = np.clip(np.rint(x), 0, 255)
        return out


class _Reader:
    """Bits of one entropy-coded interval, without stuffing; ones follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def bits(self, k: int) -> int:
        while self.n < k:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.n += 8
        self.n -= k
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bits(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("a code isn't in its Huffman table")

    def signed(self, size: int) -> int:
        v = self.bits(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _huffman(body: bytes) -> Iterator[tuple[int, dict]]:
    at = 0
    while at < len(body):
        counts, table, code, k = body[at + 1 : at + 17], {}, 0, at + 17
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[length, code] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
        yield body[at], table
        at = k


_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def decode(data: bytes) -> Image:
    """All scans of a progressive JPEG; ValueError if it is none, or damaged."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, image, quant, tables, restart, note = 2, None, {}, {}, 0, None
    while True:
        if len(data) < at + 2 or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            note = body
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide, tq = body[k] >> 4, body[k] & 15
                quant[tq] = np.frombuffer(body[k + 1 : k + 1 + 64 * (1 + wide)], dtype=">u2" if wide else np.uint8).astype(np.int32)
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC2:
            image = _frame(body, quant)
        elif marker in (0xC0, 0xC1, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise ValueError("not a progressive, Huffman-coded JPEG")
        elif marker == 0xC4:
            tables |= dict(_huffman(body))
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            end = _MARK.search(data, at)
            if image is None or end is None:
                raise ValueError("a scan is out of place or cut short")
            _read_scan(image, body, tables, restart, data[at : end.start()])
            at = end.start()
    if image is None:
        raise ValueError("no frame")
    image.note = note
    return image


def _frame(body: bytes, quant: dict) -> Image:
    _, height, width, n = struct.unpack(">BHHB", body[:6])
    parts = {body[6 + 3 * i]: Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
    hm, vm = (max(getattr(c, k) for c in parts.values()) for k in "hv")
    rows, cols = -(-height // (8 * vm)), -(-width // (8 * hm))
    for c in parts.values():
        c.padded = (rows * c.v, cols * c.h)
        c.blocks = (-(-(-(-height * c.v // vm)) // 8), -(-(-(-width * c.h // hm)) // 8))
        c.coefs = np.zeros((*c.padded, BLOCK), dtype=np.int32)
    return Image(width, height, parts, quant)


def _read_scan(image: Image, head: bytes, tables: dict, restart: int, data: bytes) -> None:
    parts = [(image.components[head[1 + 2 * i]], head[2 + 2 * i]) for i in range(head[0])]
    first, last, bits = head[-3], head[-2], head[-1]
    high, low = bits >> 4, bits & 15
    if not restart and _read_even(parts, first, last, high, low, tables, data):
        return
    pieces = [x.replace(b"\xff\x00", b"\xff") for x in _RESTART.split(data)]
    order = _order(parts)
    step = restart or len(order)
    for i, piece in enumerate(pieces):
        reader, pred, run = _Reader(piece), {}, [0]
        for group in order[i * step : (i + 1) * step]:
            for c, td, r, q in group:
                block = c.coefs[r, q]
                if first == 0:
                    if high:
                        block[0] |= reader.bits(1) << low
                    else:
                        pred[id(c)] = pred.get(id(c), 0) + reader.signed(reader.symbol(tables[td >> 4]))
                        block[0] = pred[id(c)] << low
                elif high:
                    _refine(reader, block, tables[0x10 | td & 15], first, last, low, run)
                else:
                    _first(reader, block, tables[0x10 | td & 15], first, last, low, run)


def _order(parts: list[tuple[Component, int]]) -> list[list[tuple[Component, int, int, int]]]:
    """The MCUs of a scan, each a list of component, tables, block row and column."""
    if len(parts) == 1:
        c, t = parts[0]
        return [[(c, t, r, q)] for r in range(c.blocks[0]) for q in range(c.blocks[1])]
    rows, cols = parts[0][0].padded[0] // parts[0][0].v, parts[0][0].padded[1] // parts[0][0].h
    return [[(c, t, r * c.v + i, q * c.h + j) for c, t in parts for i in range(c.v) for j in range(c.h)] for r in range(rows) for q in range(cols)]


def _first(reader: _Reader, block: np.ndarray, table: dict, first: int, last: int, low: int, run: list[int]) -> None:
    if run[0]:
        run[0] -= 1
        return
    k = first
    while k <= last:
        s = reader.symbol(table)
        r, size = s >> 4, s & 15
        if size:
            k += r
            block[k] = reader.signed(size) * (1 << low)
            k += 1
        elif r == 15:
            k += 16
        else:
            run[0] = (1 << r) + (reader.bits(r) if r else 0) - 1
            return


def _refine(reader: _Reader, block: np.ndarray, table: dict, first: int, last: int, low: int, run: list[int]) -> None:
    def correct(k: int) -> None:
        if reader.bits(1) and not abs(int(block[k])) >> low & 1:
            block[k] += (1 << low) if block[k] > 0 else -(1 << low)

    k = first
    if not run[0]:
        while k <= last:
            s = reader.symbol(table)
            r, size = s >> 4, s & 15
            new = 0
            if size:
                new = (1 << low) if reader.bits(1) else -(1 << low)
            elif r != 15:
                run[0] = (1 << r) + (reader.bits(r) if r else 0)
                break
            while k <= last:
                if block[k]:
                    correct(k)
                elif r == 0:
                    if new:
                        block[k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
    if run[0]:
        for j in range(k, last + 1):
            if block[j]:
                correct(j)
        run[0] -= 1


def _read_even(parts: list[tuple[Component, int]], first: int, last: int, high: int, low: int, tables: dict, data: bytes) -> bool:
    """Read a scan whose fields all have one width, as a bit matrix; False (and nothing done) if it isn't one."""
    c, td = parts[0]
    if any(x.padded != x.blocks or x.padded != c.padded or x.h != c.h or x.v != c.v for x, _ in parts) or len(parts) > 1 and (c.h, c.v) != (1, 1):
        return False
    n, m = c.coefs.shape[0] * c.coefs.shape[1], len(parts)

    def only(number: int) -> int | None:
        t = tables.get(number)
        return next(iter(t.values())) if t and len(t) == 1 and next(iter(t)) == (1, 0) else None

    if first == 0 and high:
        width = 1
    elif first == 0:
        sizes = {only(t >> 4) for _, t in parts}
        if len(sizes) > 1 or not (size := sizes.pop()):
            return False
        width = 1 + size
    elif high:
        if only(0x10 | td & 15) != 0 or not c.coefs[:, :, first : last + 1].all():
            return False
        width = last - first + 2
    else:
        size = only(0x10 | td & 15)
        if not size or size >> 4:
            return False
        width = (1 + size) * (last - first + 1)
    raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), dtype=np.uint8)
    if len(raw) != -(-n * m * width // 8):
        raise ValueError("a scan has the wrong length")
    flats = [x.coefs.reshape(n, BLOCK) for x, _ in parts]
    tops = []
    for at in range(0, n, PIECE):
        to = min(at + PIECE, n)
        bits = np.unpackbits(raw[at * m * width // 8 : -(-to * m * width // 8)], count=(to - at) * m * width)
        if first == 0 and high:
            bits = bits.reshape(-1, m)
            for j, f in enumerate(flats):
                f[at:to, 0] |= bits[:, j].astype(np.int32) << low
        elif first == 0:
            v = _signed(bits.reshape(-1, m, width)[:, :, 1:])
            tops.append(v)
        elif high:
            more = bits.reshape(-1, width)[:, 1:].astype(np.int32) << low
            part = flats[0][at:to, first : last + 1]
            part += np.where(np.abs(part) & (1 << low), 0, np.sign(part) * more)
        else:
            v = _signed(bits.reshape(-1, last - first + 1, 1 + size)[:, :, 1:])
            flats[0][at:to, first : last + 1] = v * (1 << low)
    if tops:
        dc = np.cumsum(np.concatenate(tops), axis=0)
        for j, f in enumerate(flats):
            f[:, 0] = dc[:, j] << low
    return True


def _signed(bits: np.ndarray) -> np.ndarray:
    size = bits.shape[-1]
    if size == 8:
        v = np.packbits(bits, axis=-1)[..., 0].astype(np.int32)
    else:
        v = bits.astype(np.float32) @ (1 << np.arange(size - 1, -1, -1)).astype(np.float32)
        v = v.astype(np.int32)
    return np.where(bits[..., 0] > 0, v, v - (1 << size) + 1)


def payload(image: Image) -> bytes:
    """The bytes that a carrier holds; ValueError for other images."""
    if image.note is None or not image.note.startswith(NOTE):
        raise ValueError("not a carrier")
    size = struct.unpack(">Q", image.note[len(NOTE) :])[0]
    out = np.stack([c.coefs.reshape(-1, BLOCK) for c in image.components.values()], axis=1)
    out[:, :, 1:] -= 256
    out[::2, :, 0] -= 512
    out[1::2, :, 0] *= -1
    if out.min() < 0 or out.max() > 255:
        raise ValueError("a coefficient isn't a byte's")
    return out.astype(np.uint8).tobytes()[:size]


# ---------------------------------------------------------------------------------------------- columns


def encode_column(df: DataFrame, data_col: str, media_col: str = "media") -> DataFrame:
    """df with a column of carriers of data_col (string or binary, in UTF-8; null: empty), padded with spaces to whole units."""
    base = df.drop(media_col)
    at, names = base.columns.index(data_col), [*base.columns, media_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                made = [encode(pad(x or b"")) for x in part.column(at).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=names)

    return base.mapInArrow(run, StructType([*base.schema.fields, *StructType.fromDDL(f"`{media_col}` binary").fields]))


def decode_column(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with width, height and rgb (full-resolution tensor, row by row, 3 bytes a pixel) of the images; nulls stay null, a damaged image fails."""
    base = df.drop("width", "height", "rgb")
    at, names = base.columns.index(media_col), [*base.columns, "width", "height", "rgb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                got = [None if x is None else decode(x) for x in part.column(at).to_pylist()]
                cols = [pa.array([g and g.width for g in got], pa.int32()), pa.array([g and g.height for g in got], pa.int32()), pa.array([g and g.rgb().tobytes() for g in got], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=names)

    return base.mapInArrow(run, StructType([*base.schema.fields, *StructType.fromDDL("width int, height int, rgb binary").fields]))


def features(image: Image) -> str:
    """Size, and per channel the mean and the mean square of the full-resolution tensor, to three places."""
    t = image.rgb().reshape(-1, 3)
    n = len(t)
    sums = t.sum(axis=0, dtype=np.int64)
    squares = [int(np.dot(x, x)) for x in t.T.astype(np.float64)]
    return f"{image.width}x{image.height} " + " ".join(f"{s / n:.3f}/{q / n:.3f}" for s, q in zip(sums.tolist(), squares, strict=True))


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text as a carrier column, read each carrier back, and describe payload, stored form and decoded tensor.

    A null text is empty and so one unit of spaces; equal texts have equal rows but for the id; repeated rows and null
    ids stay; an empty table gives an empty result.
    """
    stored = encode_column(docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("__n")), "__text").drop("__text")
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, media in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                image = decode(media)
                data = payload(image)
                rows.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(image)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_col, *(x.split()[0] for x in DIGESTS.split(", "))])

    return stored.mapInArrow(run, f"`{id_col}` {kind}, {DIGESTS}")
