"""SentencePiece model files: unigram Viterbi over a double-array trie, byte fallback, decoding.

Log scores: a UNIGRAM file's own scores. A BPE file has merge ranks instead of log
probabilities; its pieces, in order of rank, get Zipf log probabilities -log(rank + 2) - log(H).
As in the public unigram encoder, a character that no piece covers costs the smallest score
less 10 and is written as byte pieces, and of equally good segmentations the one whose last
piece is longest wins.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import blobs, sliced, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
VOCABULARY = "piece_bpe_32k.model"
#: Bytes of text that are split and looked up at once.
GROUP_BYTES = 8_000_000
#: Words whose ids are remembered; beyond, a worker begins anew.
KNOWN_WORDS = 500_000


def default_model() -> str:
    """Path of the public 32k vocabulary; executors resolve it on their own installation."""
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        r = s = 0
        while True:
            x = b[i]
            i += 1
            r |= (x & 127) << s
            s += 7
            if x < 128:
                return r

    while i < len(b):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = varint() if key & 7 == 2 else {5: 4, 1: 8}[key & 7]
        yield key >> 3, b[i : i + n]
        i += n


class DoubleArray:
    """A static trie over bytes in two arrays: child of s by c is t = base[s] + c where check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for k, v in keys.items():
            node = tree
            for c in k:
                node = node.setdefault(c, {})
            node[-1] = v
        base, check, value = [0] * 4096, [-1] * 4096, [-1] * 4096
        check[0] = 0
        start = [1] * 257  # by number of children: where the search for a free base begins
        todo = [(0, tree)]
        for s, node in todo:
            if -1 in node:
                value[s] = node[-1]
            codes = sorted(c for c in node if c >= 0)
            if not codes:
                continue
            b, tries = max(1, start[len(codes)] - codes[0]), 0
            while True:
                if b + 300 > len(check):
                    more = len(check)
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                if all(check[b + c] < 0 for c in codes):
                    break
                b += 1
                tries += 1
            if tries > 32:  # the part behind is nearly full for nodes of this size
                start[len(codes)] = b + codes[0]
            base[s] = b
            for c in codes:
                check[b + c] = s
            todo += [(b + c, node[c]) for c in codes]
        pad = max(base) + 257 - len(check)
        if pad > 0:
            base, check, value = base + [0] * pad, check + [-1] * pad, value + [-1] * pad
        self.base, self.check, self.value = base, check, value


class Model:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        pieces, kind = [], 1
        self.add_dummy_prefix = self.collapse_spaces = self.escape_spaces = True
        for n, v in fields(raw):
            if n == 1:
                x = dict(fields(v))
                pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif n == 2:
                kind = dict(fields(v)).get(3, 1)
            elif n == 3:
                x = dict(fields(v))
                self.add_dummy_prefix, self.collapse_spaces, self.escape_spaces = (bool(x.get(k, 1)) for k in (3, 4, 5))
        self.pieces = [p for p, _, _ in pieces]
        matched = [i for i, (_, _, t) in enumerate(pieces) if t in (NORMAL, USER_DEFINED)]
        self.scores = [s for _, s, _ in pieces]
        if kind == 2:
            ranked = sorted(matched, key=lambda i: (-pieces[i][1], i))
            h = math.log(sum(1 / (r + 2) for r in range(len(ranked))))
            for r, i in enumerate(ranked):
                self.scores[i] = -math.log(r + 2) - h
        # float32, as the files have it
        self.scores = [float(x) for x in np.array(self.scores, np.float32)]
        self.unknown = min(self.scores[i] for i in matched) - 10.0
        self.trie = DoubleArray({self.pieces[i].encode(): i for i in matched})
        self.unk_id = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.surface = [bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else p.replace(MARK, " ").encode() for p, _, t in pieces]
        self.surfaces = pa.array(self.surface, pa.large_binary())
        #: No piece has a marker behind another character, so a text may be cut before markers; nor a newline beside anything.
        self.cuts_at_mark = not any(MARK in self.pieces[i].lstrip(MARK) for i in matched)
        self.cuts_at_newline = not any("\n" in self.pieces[i] and len(self.pieces[i]) > 1 for i in matched)
        self.arrays = (np.array(self.trie.base), np.array(self.trie.check), np.array(self.trie.value), np.array(self.scores))
        self.known, self.known_ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text in which spaces are already markers."""
        b = text.encode()
        n = len(b)
        best, back, piece = [-1e300] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, scores, unknown = self.trie.base, self.trie.check, self.trie.value, self.scores, self.unknown
        i = 0
        while i < n:
            here, c = best[i], b[i]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            s, j, single = 0, i, False
            while j < n:
                t = base[s] + b[j]
                if check[t] != s:
                    break
                s = t
                j += 1
                v = value[s]
                if v >= 0:
                    if j == i + width:
                        single = True
                    x = here + scores[v]
                    if x > best[j]:
                        best[j], back[j], piece[j] = x, i, v
            if not single:
                j = i + width
                x = here + unknown
                if x > best[j]:
                    best[j], back[j], piece[j] = x, i, -1
            i += width
        out, j = [], n
        while j:
            i = back[j]
            if piece[j] >= 0:
                out.append(piece[j])
            elif self.byte_ids:
                out += [self.byte_ids[x] for x in reversed(b[i:j])]
            elif not out or out[-1] != self.unk_id:  # a run of unknown characters is one piece
                out.append(self.unk_id)
            j = i
        return out[::-1]

    def viterbi_many(self, words: pa.Array) -> pa.LargeBinaryArray:
        """int32 ids of many texts. Short ones, in order of length, go many at once: one Viterbi step in numpy serves the same position of all."""
        raw = words.cast(pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, 8 * raw.offset)
        flat, lens = np.frombuffer(raw.buffers()[2] or b"", np.uint8), np.diff(ends)
        order = np.argsort(lens, kind="stable")
        order = order[(lens[order] > 0) & (lens[order] <= 64)]
        found, where = [], []
        for k in range(0, len(order), 16384):
            own = order[k : k + 16384]
            wide = int(lens[own[-1]])
            text = np.zeros((len(own), wide + 1), np.int64)
            col = np.arange(wide)
            inside = col < lens[own, None]
            text[:, :wide][inside] = flat[(ends[own, None] + col)[inside]]
            ids, count, one_by_one = self._viterbi_block(text.ravel(), lens[own], wide + 1)
            one_by_one |= ((text[:, :wide] == 0) & inside).any(axis=1)  # no piece has byte 0 in the block
            at = np.concatenate([[0], np.cumsum(4 * count)])
            block = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)])
            found.append(block.filter(pa.array(~one_by_one)))
            where.append(own[~one_by_one])
        left = np.ones(len(words), bool)
        for own in where:
            left[own] = False
        rest = np.flatnonzero(left)
        found.append(pa.array([np.array(self.viterbi(words[int(i)].as_py()), np.int32).tobytes() for i in rest], pa.large_binary()))
        back = np.empty(len(words), np.int64)
        back[np.concatenate([*where, rest])] = np.arange(len(words))
        return pa.concat_arrays(found).take(pa.array(back))

    def _viterbi_block(self, text: np.ndarray, lens: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts of at most ``wide`` - 1 bytes in rows of ``wide`` -> ids one text after another, ids of each, and whether it has an unknown character."""
        base, check, value, scores = self.arrays
        n = len(lens)
        best = np.full(n * wide, -np.inf)
        back, piece = np.zeros(n * wide, np.int16), np.full(n * wide, -1, np.int32)
        origin = np.arange(n) * wide
        best[origin] = 0
        for i in range(wide - 1):
            off = origin[lens > i]
            off = off[best.take(off + i) > -np.inf]
            first = text.take(off + i)
            end = off + i + 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
            x = best.take(off + i) + self.unknown  # overwritten below where the character is a piece: any piece scores more
            better = np.flatnonzero(x > best.take(end))
            to = end.take(better)
            best[to], back[to], piece[to] = x.take(better), i, -1
            state = np.zeros(len(off), np.int64)
            for j in range(i, wide - 1):
                t = base.take(state) + text.take(off + j)
                ok = np.flatnonzero(check.take(t) == state)
                if not len(ok):
                    break
                off, state = off.take(ok), t.take(ok)
                v = value.take(state)
                hit = np.flatnonzero(v >= 0)
                o, v = off.take(hit), v.take(hit)
                x = best.take(o + i) + scores.take(v)
                o += j + 1
                better = np.flatnonzero(x > best.take(o))
                o = o.take(better)
                best[o], back[o], piece[o] = x.take(better), i, v.take(better)
        ids, count, unknown = np.zeros((n, wide), np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
        rows, at = np.arange(n), lens.copy()
        while len(rows):
            here = rows * wide + at[rows]
            ids[rows, wide - 1 - count[rows]] = piece[here]
            unknown[rows] |= piece[here] < 0
            count[rows] += 1
            at[rows] = back[here]
            rows = rows[at[rows] > 0]
        return ids[np.arange(wide) >= wide - count[:, None]], count, unknown

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """Parts of each text that no piece straddles, with spaces as markers; some may be empty."""
        if self.collapse_spaces:
            texts = pc.utf8_trim(pc.replace_substring_regex(texts, " +", " "), " ")
        if self.add_dummy_prefix:
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, ""))
        if not (self.cuts_at_mark and self.cuts_at_newline and self.escape_spaces):
            whole = pc.replace_substring(texts, " ", MARK) if self.escape_spaces else texts
            return pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1, dtype=np.int32)), whole)
        runs = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK))
        if not pc.any(runs).as_py():
            return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", " " + MARK), "\n", " \n "), " ")
        marked = pc.replace_substring(texts, " ", MARK)
        return pc.split_pattern(pc.replace_substring(pc.replace_substring_regex(marked, f"({MARK}+)", r" \1"), "\n", " \n "), " ")

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, int64 offsets: where each text's begin and end). Null text: no ids.

        A group of texts of bounded size at a time is split and dictionary-encoded in Arrow, so that
        only distinct words are looked up, and only new ones searched.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        found: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + GROUP_BYTES)))
            lists = self._cut(texts.slice(i, j - i))
            parts = lists.flatten().dictionary_encode()
            if len(self.known) > KNOWN_WORDS:
                self.known, self.known_ids = self.known[:0], self.known_ids[:0]
            at_known = pc.index_in(parts.dictionary, value_set=self.known)
            new = parts.dictionary.filter(pc.is_null(at_known))
            known = len(self.known)
            if len(new):
                self.known, self.known_ids = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.known_ids, self.viterbi_many(new)])
            word = at_known.fill_null(-1).to_numpy(zero_copy_only=False).copy()
            word[word < 0] = np.arange(known, known + len(new))
            coded = self.known_ids.take(pa.array(word[parts.indices.to_numpy()]))
            at = np.frombuffer(coded.buffers()[1], np.int64, len(coded) + 1, 8 * coded.offset) // 4
            found.append(np.frombuffer(coded.buffers()[2], np.int32)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.int32))
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            counts.append(np.diff(at[ends]))
            i = j
        flat = np.concatenate(found) if found else np.empty(0, np.int32)
        return flat, np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else np.empty(0, np.int64))]).astype(np.int64)

    def decode_array(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The bytes of each text whose ids are ids[at[k]:at[k + 1]]."""
        if not len(ids):
            return [b""] * (len(at) - 1)
        got = self.surfaces.take(pa.array(ids))
        ends = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1, 8 * got.offset)[at].tolist()
        raw = got.buffers()[2].to_pybytes()
        cut = 1 if self.add_dummy_prefix else 0
        return [raw[x + 1 : y] if cut and raw[x : x + 1] == b" " and y > x else raw[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian int32 ids of each text."""
        ids, at = self.encode_array(pa.array(texts, pa.string()))
        raw, ends = ids.tobytes(), (4 * at).tolist()
        return [raw[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def encode_bytes(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        b = b"".join(map(self.surface.__getitem__, ids))
        if self.add_dummy_prefix and b[:1] == b" ":
            b = b[1:]
        return b.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str | None = None) -> Model:
    return Model(path or default_model())


CODED = "doc_id long, ids array<int>, decoded string, n_ids long, ids_sha256 string, decoded_sha256 string, lossless boolean"


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))


def _coded(model_path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model_path)
        for big in batches:
            for b in sliced(big, "text", GROUP_BYTES):
                ids, at = m.encode_array(b.column("text"))
                back = m.decode_array(ids, at)
                raw, ends = ids.tobytes(), (4 * at).tolist()
                coded = (raw[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True))
                shas = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (coded, back)]
                same = pa.array([x == t for x, t in zip(back, blobs(b.column("text")), strict=True)], pa.bool_())
                decoded = pa.array([x.decode("utf-8", "replace") for x in back], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(ids, at), decoded, pa.array(np.diff(at)), *shas, same], [c.split()[0] for c in CODED.split(", ")])

    return run


def encode_column(docs: DataFrame, column: str = "text", to: str = "ids", model_path: str | None = None) -> DataFrame:
    """Append ``to``, an int array of piece ids of ``column``. Null text: no ids. A column already named ``to`` is replaced."""
    from pyspark.sql import types as T

    docs = docs.drop(to)
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model_path)
        for b in (x for big in batches for x in sliced(big, column, GROUP_BYTES)):
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(*m.encode_array(b.column(column)))], [*b.schema.names, to])

    return docs.mapInArrow(run, schema)


def decode_column(docs: DataFrame, column: str = "ids", to: str = "decoded", model_path: str | None = None) -> DataFrame:
    """Append ``to``, the text of the ids in ``column``. Null ids: empty text. A column already named ``to`` is replaced."""
    from pyspark.sql import types as T

    docs = docs.drop(to)
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model_path)
        for b in batches:
            lists = b.column(column)
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            back = m.decode_array(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lens)]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.decode("utf-8", "replace") for x in back], pa.string())], [*b.schema.names, to])

    return docs.mapInArrow(run, schema)


def tokenised(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """All columns of ``docs`` and ids (array<int>), n_ids, and lossless: decoding gives the text back.

    Null text: no ids, lossless. Columns already of these names are replaced.
    """
    from pyspark.sql import types as T

    docs = docs.drop("ids", "n_ids", "lossless")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("lossless", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model_path)
        for big in batches:
            for b in sliced(big, "text", GROUP_BYTES):
                ids, at = m.encode_array(b.column("text"))
                same = [x == t for x, t in zip(m.decode_array(ids, at), blobs(b.column("text")), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(ids, at), pa.array(np.diff(at)), pa.array(same, pa.bool_())], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Each whole document as piece ids and as their decoded text, with digests of both; null or empty text has no ids and the empty text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.mapInArrow(_coded(None), CODED)
