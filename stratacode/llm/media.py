"""Media columns: progressive JPEG with whole coefficient arrays.

:func:`decode` accumulates spectral-selection and successive-approximation scans into one
coefficient array a component, inverse-transforms in numpy, upsamples chroma and gives a
full-resolution RGB tensor. It reads any Huffman-coded progressive file of 8 bits and one or
three components. :func:`store_payload` keeps arbitrary bytes losslessly as a 4:2:0 file's
quantised coefficients (one byte a coefficient, 64 a block), in six scans: DC and AC of each
component first without their last bit, then refinements with it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, table


def zigzag() -> np.ndarray:
    """Natural position of each coefficient in the order of increasing frequency."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


ZIGZAG = zigzag()
_k, _n = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
#: DCT-III basis: sample n of frequency k.
BASIS = np.where(_k == 0, np.sqrt(0.125), 0.5 * np.cos((2 * _n + 1) * _k * np.pi / 16)).astype(np.float32)


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, number: int, symbols: list[int], length: int) -> bytes:
    """A Huffman table whose codes all have one length."""
    counts = [0] * 16
    counts[length - 1] = len(symbols)
    return _segment(0xC4, bytes([kind << 4 | number, *counts, *symbols]))


TABLES = _table(0, 0, list(range(12)), 4) + _table(1, 0, [0x07], 1) + _table(1, 1, [r << 4 for r in range(15)], 4)


def _scan(component: int, dc: int, ac: int, lo: int, hi: int, high: int, low: int, bits: np.ndarray | bytes) -> bytes:
    raw = bits if isinstance(bits, bytes) else np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()
    head = _segment(0xDA, bytes([1, component, dc << 4 | ac, lo, hi, high << 4 | low]))
    return head + raw.replace(b"\xff", b"\xff\x00")


def _end_runs(n: int) -> Iterator[int]:
    while n:
        yield min(n, 32767)
        n -= min(n, 32767)


def store_payload(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload (a multiple of 64 bytes)."""
    n = len(payload) // 64
    units = -(-n // 6)
    wide = min(units, 4095)
    high = -(-units // wide)
    units = wide * high
    blocks = np.full((units * 6, 64), 128, np.uint8)
    blocks[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % n), _segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(TABLES)
    parts = (blocks[: 4 * units], blocks[4 * units : 5 * units], blocks[5 * units :])
    first, second = [], []
    for c, part in enumerate(parts):
        dc = part[:, 0].astype(np.int64)  # a byte b stands for coefficient b, or b - 255 below 128: category 8, with b as extra bits
        dc[dc < 128] -= 255
        odd = (dc & 1).astype(np.uint8)
        dc >>= 1
        diff = np.diff(dc, prepend=0)
        size = np.frexp(np.abs(diff).astype(np.float32))[1].astype(np.int64)  # bits of the magnitude
        extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
        code = (size << size) | extra
        total = 4 + size
        shift = total.max() - 1 - np.arange(total.max())
        # each block's code, left-aligned in a row of bits of which only the first `total` count
        grid = (code[:, None] << (total.max() - total)[:, None]) >> shift[None, :] & 1
        first.append(_scan(c + 1, 0, 0, 0, 0, 0, 1, grid[np.arange(total.max())[None, :] < total[:, None]].astype(np.uint8)))
        # AC: code 0 (run 0, category 7), then seven bits: the byte's upper bits
        first.append(_scan(c + 1, 0, 0, 1, 63, 0, 1, _seven(part[:, 1:])))
        second.append(_scan(c + 1, 0, 0, 0, 0, 1, 0, odd))
        bits, at = [], 0
        low = LAST[part[:, 1:]]
        for run in _end_runs(len(part)):
            r = run.bit_length() - 1
            head = [int(x) for x in f"{r:04b}" + (f"{run - (1 << r):0{r}b}" if r else "")]
            bits += [np.array(head, np.uint8), low[at : at + run].ravel()]
            at += run
        second.append(_scan(c + 1, 0, 1, 1, 63, 1, 0, np.concatenate(bits)))
    return b"".join([*out, *first, *second, b"\xff\xd9"])


def _half(b: int) -> int:
    """Category-7 extra bits, behind a 0 bit, of the byte's coefficient halved towards zero."""
    return b >> 1 if b >= 128 else 127 - ((255 - b) >> 1)


#: The last bit of the magnitude of each byte's coefficient.
LAST = np.array([(b if b >= 128 else 255 - b) & 1 for b in range(256)], np.uint8)
HALF = np.array([_half(b) for b in range(256)], np.uint8)


def _seven(b: np.ndarray) -> bytes:
    return HALF[b].tobytes()


# ---------------------------------------------------------------- reading


class _Codes:
    """A Huffman table: symbol and code length by the next 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbols, self.lengths = symbols, {n + 1 for n, c in enumerate(counts) if c}
        self.symbol, self.length = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
        code = k = 0
        for n, c in enumerate(counts, 1):
            for _ in range(c):
                at = code << (16 - n)
                self.symbol[at : at + (1 << (16 - n))] = symbols[k]
                self.length[at : at + (1 << (16 - n))] = n
                code += 1
                k += 1
            code <<= 1
        self.symbol_bytes, self.length_bytes = self.symbol.tobytes(), self.length.tobytes()
        self.only_end_runs = all(s & 15 == 0 and s != 0xF0 for s in symbols)


#: Values of a one-bit code followed by seven extra bits.
SEVEN = np.array([x if x >= 64 else x - 127 for x in range(128)] * 2, np.int32)
_codes = lru_cache(maxsize=64)(_Codes)


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.list: list[int] | None = None
        self.at = 0

    def get(self, n: int) -> int:
        if self.list is None:
            self.list = self.bits.tolist() + [1] * 64
        x = 0
        for b in self.list[self.at : self.at + n]:
            x = x << 1 | b
        self.at += n
        return x

    def symbol(self, codes: _Codes) -> int:
        p = self.get(16)
        n = int(codes.length[p])
        if not n:
            raise ValueError("bad Huffman code")
        self.at += n - 16
        return int(codes.symbol[p])

    def signed(self, size: int) -> int:
        x = self.get(size)
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


def _dc_first(data: bytes, codes: _Codes, n: int, low: int) -> np.ndarray:
    """DC values of n blocks of one component, each code and its extra bits from one 40-bit window."""
    data += b"\xff" * 8
    symbol, length, from_bytes = codes.symbol_bytes, codes.length_bytes, int.from_bytes
    out, p, pred = [], 0, 0
    for _ in range(n):
        i, w = p >> 3, p & 7
        w, room = from_bytes(data[i : i + 5]), 40 - w
        peek = w >> (room - 16) & 0xFFFF
        size, used = symbol[peek], length[peek]
        if size:
            x = w >> (room - used - size) & ((1 << size) - 1)
            pred += x if x >> (size - 1) else x - (1 << size) + 1
        out.append(pred)
        p += used + size
    return np.array(out, np.int64) << low


class Decoder:
    def __init__(self, data: bytes):
        self.tables: dict[int, _Codes] = {}
        self.quant: dict[int, np.ndarray] = {}
        self.comment = b""
        self.restart = 0
        i = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while i < len(data):
            if data[i] != 0xFF:
                raise ValueError("marker expected")
            m = data[i + 1]
            i += 2
            if m == 0xD9:
                break
            (n,) = struct.unpack_from(">H", data, i)
            body = data[i + 2 : i + n]
            i += n
            if m == 0xC4:
                while body:
                    total = sum(body[1:17])
                    self.tables[body[0]] = _codes(body[1:17], body[17 : 17 + total])
                    body = body[17 + total :]
            elif m == 0xDB:
                while body:
                    q = np.frombuffer(body[1:129], ">u2") if body[0] >> 4 else np.frombuffer(body[1:65], np.uint8)
                    self.quant[body[0] & 15] = q.astype(np.int64)
                    body = body[1 + 64 * (1 + (body[0] >> 4)) :]
            elif m == 0xFE:
                self.comment = body
            elif m == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif m == 0xC2:
                _, self.height, self.width, k = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(k)]
                self.hmax, self.vmax = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
                self.mcu_w, self.mcu_h = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
                self.coef = [np.zeros((self.mcu_h * v, self.mcu_w * h, 64), np.int32) for _, h, v, _ in self.parts]
            elif m == 0xDA:
                end = i
                while True:  # entropy-coded data go on to the next marker but stuffed bytes and restarts
                    end = data.index(b"\xff", end)
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                        continue
                    break
                self.scan(body, data[i:end])
                i = end
            elif 0xC0 <= m <= 0xCF and m not in (0xC8, 0xCC):
                raise ValueError("only progressive Huffman files")

    def scan(self, head: bytes, data: bytes) -> None:
        k = head[0]
        which = [next(c for c, p in enumerate(self.parts) if p[0] == head[1 + 2 * j]) for j in range(k)]
        tables = [head[2 + 2 * j] for j in range(k)]
        lo, hi, a = head[1 + 2 * k : 4 + 2 * k]
        high, low = a >> 4, a & 15
        pieces, start = [], 0
        if self.restart:
            at = 0
            while (at := data.find(b"\xff", at)) >= 0:
                if data[at + 1]:
                    pieces.append(data[start:at])
                    start = at + 2
                at += 2
        pieces.append(data[start:])
        order = list(self.blocks(which)) if k > 1 else None
        if k == 1:
            c = which[0]
            _, h, v, _ = self.parts[c]
            rows, cols = -(-(-(-self.height * v // self.vmax)) // 8), -(-(-(-self.width * h // self.hmax)) // 8)
            flat = self.coef[c][:rows, :cols]
            if not self.restart and self.bulk(flat, data.replace(b"\xff\x00", b"\xff"), tables[0], lo, hi, high, low):
                return
            order = [(0, [(c, y, x)]) for y in range(rows) for x in range(cols)]
        per = self.restart or len(order)
        for r, piece in enumerate(pieces):
            bits, pred, run = _Bits(piece.replace(b"\xff\x00", b"\xff")), [0] * len(self.parts), 0
            for _, unit in order[r * per : (r + 1) * per]:
                for c, y, x in unit:
                    block, t = self.coef[c][y, x], tables[which.index(c)]
                    if lo == 0:
                        if high:
                            block[0] |= bits.get(1) << low
                        else:
                            pred[c] += bits.signed(bits.symbol(self.tables[t >> 4]))
                            block[0] = pred[c] << low
                    elif high:
                        run = self.refine(bits, block, self.tables[0x10 | t & 15], lo, hi, low, run)
                    elif run:
                        run -= 1
                    else:
                        run = self.first(bits, block, self.tables[0x10 | t & 15], lo, hi, low)

    def blocks(self, which: list[int]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        for m in range(self.mcu_w * self.mcu_h):
            y, x = divmod(m, self.mcu_w)
            yield m, [(c, y * self.parts[c][2] + v, x * self.parts[c][1] + h) for c in which for v in range(self.parts[c][2]) for h in range(self.parts[c][1])]

    def bulk(self, flat: np.ndarray, data: bytes, t: int, lo: int, hi: int, high: int, low: int) -> bool:
        """Whole-scan numpy reading where code lengths allow: DC scans, and AC scans in which nothing but one symbol or end-of-band runs occur."""
        n, shape = flat.shape[0] * flat.shape[1], flat.shape[:2]
        if lo == 0 and high:
            flat[:, :, 0] |= np.unpackbits(np.frombuffer(data, np.uint8), count=n).reshape(shape).astype(np.int32) << low
            return True
        if lo == 0:
            flat[:, :, 0] = _dc_first(data, self.tables[t >> 4], n, low).reshape(shape)
            return True
        codes = self.tables[0x10 | t & 15]
        size, wide = codes.symbols[0], hi - lo + 1
        if not high and len(codes.symbols) == 1 and codes.lengths == {1} and size == 7:
            x = np.frombuffer(data, np.uint8, n * wide).reshape(*shape, wide)
            flat[:, :, lo : hi + 1] = SEVEN[x] << low
            return True
        c = flat[:, :, lo : hi + 1]
        if high and codes.only_end_runs and c.all():
            x, at, done = np.empty((n, wide), np.uint8), 0, 0
            while done < n:
                i = at >> 3
                w, room = int.from_bytes(data[i : i + 5].ljust(5, b"\xff")), 40 - (at & 7)
                peek = w >> (room - 16) & 0xFFFF
                r, used = codes.symbol_bytes[peek] >> 4, codes.length_bytes[peek]
                if not used:
                    raise ValueError("bad Huffman code")
                run = min((1 << r) + (w >> (room - used - r) & ((1 << r) - 1)), n - done)
                at += used + r
                i, j = at >> 3, at & 7
                x[done : done + run] = np.unpackbits(np.frombuffer(data, np.uint8, -(-(j + run * wide) // 8), i), count=j + run * wide)[j:].reshape(run, wide)
                at += run * wide
                done += run
            c += ((c >> 31) | 1) * (x.reshape(*shape, wide).astype(np.int32) << low)
            return True
        return False

    @staticmethod
    def first(bits: _Bits, block: np.ndarray, codes: _Codes, lo: int, hi: int, low: int) -> int:
        k = lo
        while k <= hi:
            r, s = divmod(bits.symbol(codes), 16)
            if s:
                k += r
                block[k] = bits.signed(s) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                return (1 << r) + bits.get(r) - 1
        return 0

    @staticmethod
    def refine(bits: _Bits, block: np.ndarray, codes: _Codes, lo: int, hi: int, low: int, run: int) -> int:
        k, bit = lo, 1 << low

        def correct(k: int) -> None:
            if bits.get(1) and not abs(int(block[k])) & bit:
                block[k] += bit if block[k] > 0 else -bit

        if not run:
            while k <= hi:
                r, s = divmod(bits.symbol(codes), 16)
                new = 0
                if s:
                    new = bit if bits.get(1) else -bit
                elif r != 15:
                    run = (1 << r) + bits.get(r)
                    break
                while k <= hi:
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
        if run:
            for j in range(k, hi + 1):
                if block[j]:
                    correct(j)
            run -= 1
        return run

    def planes(self) -> list[np.ndarray]:
        out = []
        for (_, h, v, q), coef in zip(self.parts, self.coef, strict=True):
            y, x = coef.shape[:2]
            c = np.zeros((y * x, 64), np.float32)
            c[:, ZIGZAG] = coef.reshape(-1, 64) * self.quant[q]
            c = (BASIS.T @ c.reshape(-1, 8, 8) @ BASIS) + np.float32(128)
            p = np.clip(np.rint(c), 0, 255).reshape(y, x, 8, 8).transpose(0, 2, 1, 3).reshape(y * 8, x * 8)
            p = np.repeat(np.repeat(p, self.vmax // v, axis=0), self.hmax // h, axis=1)
            out.append(p[: self.height, : self.width])
        return out

    def rgb(self) -> np.ndarray:
        p = self.planes()
        if len(p) == 1:
            return np.repeat(p[0][:, :, None], 3, axis=2).astype(np.uint8)
        f = np.float32
        y, cb, cr = p[0], p[1] - f(128), p[2] - f(128)
        out = np.empty((*y.shape, 3), np.float32)
        out[:, :, 0] = y + f(1.402) * cr
        out[:, :, 1] = y - f(0.344136) * cb - f(0.714136) * cr
        out[:, :, 2] = y + f(1.772) * cb
        return np.clip(np.rint(out, out=out), 0, 255, out=out).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Height x width x 3 uint8."""
    return Decoder(data).rgb()


def read_payload(d: Decoder) -> bytes:
    n = int(d.comment.split()[1])
    v = np.concatenate([c.reshape(-1, 64) for c in d.coef])[:n]
    return np.where(v > 0, v, v + 255).astype(np.uint8).tobytes()


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 or 64 * (not text))


# ---------------------------------------------------------------- columns


def add_media(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_bytes, media: each text's padded UTF-8 as a progressive JPEG. Null text: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 256):
                b = big.slice(i, 256)
                texts = list(blobs(b.column("text")))
                media = [store_payload(padded(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def rgb_tensors(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, media) -> key, height, width, rgb (row-major uint8 bytes). Null or broken media: null columns."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 64):
                b = big.slice(i, 64)
                rows: list[tuple] = []
                for m in b.column("media"):
                    try:
                        x = decode(m.as_py()) if m.is_valid else None
                    except (ValueError, IndexError, KeyError, AttributeError, StopIteration, struct.error):
                        x = None
                    rows.append((None, None, None) if x is None else (x.shape[0], x.shape[1], x.tobytes()))
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([b.column(key), *cols], [key, "height", "width", "rgb"])

    return media.select(key, "media").mapInArrow(run, f"`{key}` {kind}, height int, width int, rgb binary")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for b in batches:
        rows = []
        for m in blobs(b.column("media")):
            d = Decoder(m)
            payload, x = read_payload(d), d.rgb()
            feature = f"{x.shape[0]}x{x.shape[1]}:" + ",".join(str(v) for v in x.reshape(-1, 3).sum(axis=0, dtype=np.int64))
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names)


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    media = add_media(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return media.mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
