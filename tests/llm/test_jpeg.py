import hashlib
import struct
import zlib

import numpy as np
import pytest

from tracewright.llm import jpeg


class Writer:
    """A plain progressive encoder: symbols and bits of a scan, then one table of 8-bit codes."""

    def __init__(self):
        self.items, self.run, self.later = [], 0, []

    def symbol(self, s):
        self.items.append(("s", s))

    def bits(self, v, n):
        self.items += [("b", v >> i & 1) for i in range(n - 1, -1, -1)]

    def signed(self, v):
        n = abs(v).bit_length()
        self.bits(v if v >= 0 else v + (1 << n) - 1, n)

    def end_run(self):
        if self.run:
            n = self.run.bit_length() - 1
            self.symbol(n << 4)
            self.bits(self.run - (1 << n), n)
            self.items += [("b", b) for b in self.later]
            self.run, self.later = 0, []

    def first(self, block, a, b, low):
        r = 0
        for k in range(a, b + 1):
            v = int(block[k])
            v = (abs(v) >> low) * (1 if v > 0 else -1)
            if not v:
                r += 1
                continue
            self.end_run()
            while r > 15:
                self.symbol(0xF0)
                r -= 16
            self.symbol(r << 4 | abs(v).bit_length())
            self.signed(v)
            r = 0
        self.run += r > 0

    def refine(self, block, a, b, low):
        t = [abs(int(v)) >> low for v in block]
        last = max([k for k in range(a, b + 1) if t[k] == 1], default=-1)
        r, fix = 0, []
        for k in range(a, b + 1):
            if not t[k]:
                r += 1
                continue
            while r > 15 and k <= last:
                self.end_run()
                self.symbol(0xF0)
                self.items += [("b", x) for x in fix]
                fix, r = [], r - 16
            if t[k] > 1:
                fix.append(t[k] & 1)
                continue
            self.end_run()
            self.symbol(r << 4 | 1)
            self.bits(int(block[k] > 0), 1)
            self.items += [("b", x) for x in fix]
            fix, r = [], 0
        if r or fix:
            self.run += 1
            self.later += fix

    def data(self, codes):
        self.end_run()
        bits = []
        for kind, v in self.items:
            bits += [v] if kind == "b" else [codes[v] >> i & 1 for i in range(7, -1, -1)]
        bits += [1] * (-len(bits) % 8)
        return np.packbits(np.array(bits, dtype=np.uint8)).tobytes().replace(b"\xff", b"\xff\0")


def write(width, height, parts, coefs, restart=0, scans=None):
    """parts: (h, v) of each component; coefs: by component, block rows by columns by 64 in zigzag order."""
    comps = {i + 1: jpeg.Component(h, v, 0) for i, (h, v) in enumerate(parts)}
    frame = struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i, c.h << 4 | c.v, 0]) for i, c in comps.items())
    shape = jpeg._frame(frame, {})
    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\0" + bytes(range(1, 65))), jpeg._segment(0xC2, frame)]
    out += [jpeg._segment(0xDD, struct.pack(">H", restart))] if restart else []
    every = list(comps)
    scans = scans or [(every, 0, 0, 0, 1)] + [([i], 1, 5, 0, 2) for i in every] + [([i], 6, 63, 0, 2) for i in every] + [([i], 1, 63, 2, 1) for i in every] + [(every, 0, 0, 1, 0)] + [([i], 1, 63, 1, 0) for i in every]
    for ids, a, b, high, low in scans:
        order = jpeg._order([(shape.components[i], i) for i in ids])
        step, writers = restart or len(order), []
        for at in range(0, len(order), step):
            w, pred = Writer(), {}
            for group in order[at : at + step]:
                for _, i, r, q in group:
                    block = coefs[i - 1][r, q]
                    if a:
                        (w.refine if high else w.first)(block, a, b, low)
                    elif high:
                        w.bits(int(block[0]) >> low & 1, 1)
                    else:
                        d = (int(block[0]) >> low) - pred.get(i, 0)
                        pred[i] = int(block[0]) >> low
                        w.symbol(abs(d).bit_length())
                        w.signed(d)
            w.end_run()
            writers.append(w)
        codes = {s: n for n, s in enumerate(sorted({v for w in writers for k, v in w.items if k == "s"}))}
        out.append(jpeg._segment(0xC4, bytes([0x10 if a else 0] + [0] * 7 + [len(codes)] + [0] * 8) + bytes(codes)))
        data = b"".join((b"\xff" + bytes([0xD0 + (n - 1) % 8]) if n else b"") + w.data(codes) for n, w in enumerate(writers))
        out.append(jpeg._scan([(i, 0) for i in ids], a, b, high, low, data))
    return b"".join([*out, b"\xff\xd9"])


def random_coefs(width, height, parts, seed):
    r = np.random.default_rng(seed)
    image = jpeg._frame(struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(parts)), {})
    out = []
    for c in image.components.values():
        x = r.integers(-40, 41, (*c.padded, 64)) * (r.random((*c.padded, 64)) < 0.15)
        x[..., 0] = r.integers(-200, 200, c.padded)
        x[c.blocks[0] :, :, 1:] = 0  # padding blocks have no AC scan
        x[:, c.blocks[1] :, 1:] = 0
        out.append(x)
    return out


@pytest.mark.parametrize("width,height,parts,restart", [(40, 24, [(1, 1)] * 3, 0), (37, 29, [(2, 2), (1, 1), (1, 1)], 0), (50, 20, [(2, 1), (1, 1), (1, 1)], 3), (19, 9, [(1, 1)], 0), (33, 17, [(1, 2), (1, 1), (1, 1)], 2)])
def test_scans_accumulate_into_the_coefficients(width, height, parts, restart):
    coefs = random_coefs(width, height, parts, width)
    image = jpeg.decode(write(width, height, parts, coefs, restart))
    for c, want in zip(image.components.values(), coefs, strict=True):
        assert (c.coefs == want).all()
    assert image.rgb().shape == (height, width, 3)


def test_inverse_transform_and_upsampling_match_the_definition():
    parts = [(2, 2), (1, 1), (1, 1)]
    coefs = [c // 8 for c in random_coefs(21, 18, parts, 3)]
    image = jpeg.decode(write(21, 18, parts, coefs))
    planes = []
    for x, (h, v) in zip(coefs, parts, strict=True):
        rows, cols = x.shape[:2]
        plane = np.zeros((rows * 8, cols * 8))
        for r in range(rows):
            for q in range(cols):
                nat = np.zeros(64)
                nat[jpeg.ZIGZAG] = x[r, q] * np.arange(1, 65)
                f = nat.reshape(8, 8)
                for i in range(8):
                    for j in range(8):
                        c = lambda k: np.sqrt(0.5) if k == 0 else 1.0
                        plane[r * 8 + i, q * 8 + j] = 128 + 0.25 * sum(c(u) * c(w) * f[u, w] * np.cos((2 * i + 1) * u * np.pi / 16) * np.cos((2 * j + 1) * w * np.pi / 16) for u in range(8) for w in range(8))
        planes.append(plane.repeat(2 // v, axis=0).repeat(2 // h, axis=1)[:18, :21])
    y, b, r = planes[0], planes[1] - 128, planes[2] - 128
    want = np.clip(np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=2), 0, 255)
    assert np.abs(image.rgb().astype(float) - want).max() <= 0.51


def test_zigzag_is_the_standard_order():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 4000, 200_000, 1_100_000])
def test_carrier_round_trip(n, monkeypatch):
    data = jpeg.pad(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes())
    media = jpeg.encode(data)
    assert len(data) % 192 == 0 and len(data) >= max(192, n) and jpeg.payload(jpeg.decode(media)) == data
    if n < 5000:  # the bit matrix and the general reader agree
        fast = jpeg.decode(media)
        monkeypatch.setattr(jpeg, "_read_even", lambda *a: False)
        assert all((a.coefs == b.coefs).all() for a, b in zip(fast.components.values(), jpeg.decode(media).components.values(), strict=True))


def test_digests_match_the_definition(spark):
    texts = [None, "", "short", "é" * 96, "x" * 192, "y" * 193, "long text " * 30_000, "short"]
    df = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in jpeg.digests(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, raw = got[i if i else None], (t or "").encode()
        data = raw + b" " * (192 - len(raw) if not raw else -len(raw) % 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        media = jpeg.encode(data)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[2][1:] == got[7][1:] and got[3]["feature"] != got[2]["feature"]
    assert jpeg.digests(df.limit(0)).collect() == []


def test_tensor_column(spark):
    df = jpeg.encode_column(spark.createDataFrame([("a",), (None,)], "text string"), "text")
    got = jpeg.decode_column(df).collect()
    assert all(len(r["rgb"]) == r["width"] * r["height"] * 3 == 192 for r in got)
