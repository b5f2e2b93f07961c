"""The progressive JPEG decoder on files of a general encoder, which is not that of the media column: runs, zero-run symbols,
end-of-band runs, refinements that bring new coefficients, interleaved scans and restarts; and the column and its query."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from stratacode.llm import media


class Out:
    def __init__(self):
        self.bits: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s: int) -> None:
        self.put(s, 9)  # all symbols but 255 have nine bits

    def number(self, v: int) -> None:
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def data(self) -> bytes:
        return np.packbits(np.array(self.bits + [1] * (-len(self.bits) % 8), np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def table(kind: int) -> bytes:
    return segment(0xC4, bytes([kind << 4, *[0] * 8, 255, *[0] * 7, *range(255)]))


def shifted(v: int, low: int) -> int:
    return (abs(v) >> low) * (1 if v > 0 else -1)


def ac_first(out: Out, blocks, lo: int, hi: int, low: int) -> None:
    empty = 0

    def flush() -> None:
        nonlocal empty
        while empty:
            r = min(empty.bit_length() - 1, 14)
            out.symbol(r << 4)
            out.put((empty if empty < 1 << 15 else (1 << 15) - 1) - (1 << r), r)
            empty -= min(empty, (1 << 15) - 1)

    for b in blocks:
        run = 0
        for k in range(lo, hi + 1):
            v = shifted(int(b[k]), low)
            if not v:
                run += 1
                continue
            flush()
            while run > 15:
                out.symbol(0xF0)
                run -= 16
            out.symbol(run << 4 | abs(v).bit_length())
            out.number(v)
            run = 0
        empty += run > 0
    flush()


def ac_refine(out: Out, blocks, lo: int, hi: int, low: int) -> None:
    for b in blocks:
        a = [abs(int(x)) >> low for x in b]
        last = max((k for k in range(lo, hi + 1) if a[k] == 1), default=-1)
        run, fixes = 0, []
        for k in range(lo, hi + 1):
            if not a[k]:
                run += 1
                continue
            while run > 15 and k <= last:
                out.symbol(0xF0)
                out.bits += fixes
                run, fixes = run - 16, []
            if a[k] > 1:
                fixes.append(a[k] & 1)
                continue
            out.symbol(run << 4 | 1)
            out.put(int(b[k] > 0), 1)
            out.bits += fixes
            run, fixes = 0, []
        if run or fixes:
            out.symbol(0)
            out.bits += fixes


def encode(coef: list[np.ndarray], height: int, width: int, shape: list[tuple[int, int]], restart: int) -> bytes:
    quant = np.arange(1, 65, dtype=np.uint8)
    hmax, vmax = max(h for h, _ in shape), max(v for _, v in shape)
    mcus = [(y, x) for y in range(-(-height // (8 * vmax))) for x in range(-(-width // (8 * hmax)))]
    file = b"\xff\xd8" + segment(0xDB, b"\0" + quant.tobytes()) + table(0) + table(1)
    file += segment(0xC2, struct.pack(">BHHB", 8, height, width, len(shape)) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(shape)))
    file += segment(0xDD, struct.pack(">H", restart))
    names = bytes([len(shape)]) + b"".join(bytes([c + 1, 0]) for c in range(len(shape)))
    units = [[(c, y * v + j, x * h + i) for c, (h, v) in enumerate(shape) for j in range(v) for i in range(h)] for y, x in mcus]
    if len(shape) == 1:
        units = [[(0, y, x)] for y in range(-(-height // 8)) for x in range(-(-width // 8))]

    def scans(head: bytes, items: list, code) -> bytes:
        per = restart or len(items)
        parts = []
        for i in range(0, len(items), per):
            out = Out()
            code(out, items[i : i + per])
            parts.append(out.data())
        return segment(0xDA, head) + b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k < len(parts) - 1 else b"") for k, p in enumerate(parts))

    def dc_first(out: Out, part: list) -> None:
        before = [0] * len(shape)
        for c, y, x in (b for u in part for b in u):
            v = int(coef[c][y, x, 0]) >> 1
            d, before[c] = v - before[c], v
            out.symbol(abs(d).bit_length())
            if d:
                out.number(d)

    def dc_refine(out: Out, part: list) -> None:
        out.bits += [int(coef[c][y, x, 0]) & 1 for u in part for c, y, x in u]

    file += scans(names + bytes([0, 0, 0 << 4 | 1]), units, dc_first)
    file += scans(names + bytes([0, 0, 1 << 4 | 0]), units, dc_refine)
    for c, (h, v) in enumerate(shape):
        rows, cols = -(-(-(-height * v // vmax)) // 8), -(-(-(-width * h // hmax)) // 8)
        blocks = [coef[c][y, x] for y in range(rows) for x in range(cols)]
        for lo, hi, high, low in ((1, 5, 0, 2), (6, 63, 0, 1), (1, 5, 2, 1), (6, 63, 1, 0), (1, 5, 1, 0)):
            code = ac_refine if high else ac_first
            file += scans(bytes([1, c + 1, 0, lo, hi, high << 4 | low]), blocks, lambda out, part, code=code, lo=lo, hi=hi, low=low: code(out, part, lo, hi, low))
    return file + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize(("height", "width", "shape"), [(37, 52, [(2, 2), (1, 1), (1, 1)]), (20, 35, [(1, 1)]), (16, 50, [(2, 1), (1, 1), (1, 1)])])
def test_general_progressive_files(height, width, shape, restart):
    rng = np.random.default_rng(height + restart)
    hmax, vmax = max(h for h, _ in shape), max(v for _, v in shape)
    coef = []
    for h, v in shape:
        y, x = -(-height // (8 * vmax)) * v, -(-width // (8 * hmax)) * h
        c = (rng.standard_normal((y, x, 64)) * np.exp(-np.arange(64) / 6) * 12).astype(np.int32)
        c[rng.random((y, x)) < 0.3, 1:] = 0  # empty bands, for end-of-band runs
        c[:, :, 40:] = np.where(rng.random((y, x, 24)) < 0.06, rng.choice([-3, -1, 1, 2], (y, x, 24)), 0)  # far apart: long zero runs
        c[:, :, 0] = rng.integers(-60, 60, (y, x))
        rows, cols = -(-(-(-height * v // vmax)) // 8), -(-(-(-width * h // hmax)) // 8)
        c[rows:, :, 1:] = 0
        c[:, cols:, 1:] = 0
        if len(shape) == 1:
            c[rows:], c[:, cols:] = 0, 0
        coef.append(c)
    d = media.Decoder(encode(coef, height, width, shape, restart))
    for got, want in zip(d.coef, coef, strict=True):
        assert (got == want).all()
    x = d.rgb()
    assert x.shape == (height, width, 3) and x.dtype == np.uint8
    plane = np.zeros(coef[0].shape[:2] + (64,))
    plane[:, :, media.ZIGZAG] = coef[0] * np.arange(1, 65)
    k, n = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.where(k == 0, np.sqrt(0.125), 0.5 * np.cos((2 * n + 1) * k * np.pi / 16))
    luma = np.einsum("uy,abuv,vx->aybx", basis, plane.reshape(*plane.shape[:2], 8, 8), basis).reshape(plane.shape[0] * 8, -1) + 128
    assert np.abs(d.planes()[0] - np.clip(luma, 0, 255)[:height, :width]).max() <= 0.51


def test_media_column_and_query(spark, tmp_path):
    texts = ["", None, "a", "x" * 63, "y" * 64, "é" * 5000, "same", "same", "� tail \U0001f600"]
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a null id", "clash")], "doc_id long, text string, media string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in media.op4_media_columns(spark, str(tmp_path)).collect()}
    stored = {r.doc_id: bytes(r.media) for r in media.add_media(d).collect()}
    for i, t in [*enumerate(texts), (None, "a null id")]:
        raw = (t or "").encode()
        full, r = raw + b"\0" * (-len(raw) % 64 if raw else 64), got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(full[-64:]), len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
        assert media.read_payload(media.Decoder(stored[i])) == full
    assert got[6].feature == got[7].feature
    frame = spark.createDataFrame([*((i, m) for i, m in stored.items()), (100, None), (101, b"\xff\xd8broken")], "doc_id long, media binary")
    for r in media.rgb_tensors(frame).collect():
        if r.doc_id in (100, 101):
            assert r.rgb is None and r.height is None
        else:
            x = media.decode(stored[r.doc_id])
            assert (r.height, r.width) == x.shape[:2] and bytes(r.rgb) == x.tobytes()
    assert media.add_media(d.limit(0)).count() == 0
