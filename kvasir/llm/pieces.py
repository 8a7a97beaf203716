"""Operator 2: SentencePiece encoding with source offsets, and decoding.

A text is normalised by longest-prefix matches in the model's compiled character map; every normalised
byte keeps the source byte it came from. Byte-pair merges run on the normalised text, and each piece's
byte range is projected through that alignment to a byte span of the original text. Ids equal the
sentencepiece library's; decoding equals its ``decode``.

Merges never cross a place that no vocabulary piece spans, so the text is cut before each run of space
symbols and around line feeds (checked against the vocabulary when the model is loaded, else the text is
one word), and a word's pieces are remembered for the next time.

Defined cases: null text counts as empty (only begin and end ids); characters outside the vocabulary fall
back to bytes, the last of which carries the span; a text or word of any length is encoded whole (long
words by a heap, in n log n); repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
import operator
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_SYMBOL = "▁"
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
REMEMBERED, LONG_WORD = 800_000, 64


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        r = s = 0
        while True:
            r |= (b[i] & 127) << s
            s, i = s + 7, i + 1
            if b[i - 1] < 128:
                return r, i

    i = 0
    while i < len(b):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            v, i = varint(i)
        else:
            n, i = (8, i) if kind == 1 else (4, i) if kind == 5 else varint(i)
            v, i = b[i : i + n], i + n
        yield key >> 3, v


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes whose leaves point at replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, int]:
        """Length of the longest key that starts at ``at`` and its replacement's place; (0, 0) if there is none."""
        units, found, n = self.units, (0, 0), len(text)
        node = self._offset(units[0])
        for i in range(at, n):
            node ^= text[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)

    def replacement(self, place: int) -> bytes:
        return self.strings[place : self.strings.index(b"\0", place)]


def _char_len(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Normalizer:
    def __init__(self, spec: bytes = b""):
        got = dict(_fields(spec))
        self.map = CharacterMap(got[2]) if got.get(2) else None
        self.dummy_prefix, self.trim, self.escape = (bool(got.get(k, 1)) for k in (3, 4, 5))

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and their end) the source byte it came from."""
        if not text:
            return b"", np.zeros(1, np.int64)
        space = SPACE_SYMBOL.encode() if self.escape else b" "
        if self.map is None and not self.trim:
            src = np.frombuffer(text, np.uint8)
            align = np.repeat(np.arange(len(src)), np.where(src == 32, len(space), 1))
            lead = len(space) if self.dummy_prefix else 0
            return space[:lead] + text.replace(b" ", space), np.concatenate((np.zeros(lead, np.int64), align, [len(src)]))
        parts: list[tuple[bytes, int]] = []
        at, n = 0, len(text)
        while at < n:
            size, place = self.map.longest(text, at) if self.map else (0, 0)
            if size:
                parts.append((self.map.replacement(place), at))
            else:
                size = _char_len(text[at])
                parts.append((text[at : at + size], at))
            at += size
        end = n
        if self.trim:
            kept, after_space = [], True
            for bit, start in parts:
                while after_space and bit.startswith(b" "):
                    bit = bit[1:]
                if bit:
                    kept.append((bit, start))
                    after_space = bit.endswith(b" ")
            while kept and kept[-1][0].endswith(b" "):
                bit, end = kept.pop()
                if bit := bit.rstrip(b" "):
                    kept.append((bit, end))
            parts = kept
        if not parts:
            return b"", np.zeros(1, np.int64)
        out, align = [], []
        if self.dummy_prefix:
            out.append(space)
            align += [parts[0][1]] * len(space)
        for bit, start in parts:
            bit = bit.replace(b" ", space)
            out.append(bit)
            align += [start] * len(bit)
        return b"".join(out), np.array([*align, end])


class PieceModel:
    """A BPE model with byte fallback."""

    def __init__(self, blob: bytes):
        pieces, spec = [], {2: b"", 3: b""}
        for number, value in _fields(blob):
            if number == 1:
                got = dict(_fields(value))
                pieces.append((got[1].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
            elif number in spec:
                spec[number] = value
        trainer = dict(_fields(spec[2]))
        if trainer.get(3) != 2 or not trainer.get(35):
            raise ValueError("only BPE models with byte fallback are read")
        self.bos, self.eos = trainer.get(41, 1), trainer.get(42, 2)
        self.normalize = Normalizer(spec[3])
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, UNUSED, USER_DEFINED)}
        self.scores = {p: s for p, s, t in pieces if t in (NORMAL, UNUSED)}
        if any(t in (USER_DEFINED, UNUSED) for _, _, t in pieces):
            raise ValueError("models with user-defined or unused pieces aren't read")
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        self.lengths: list[int] = []
        for i, (p, _, t) in enumerate(pieces):
            if t == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
            self.lengths.append(len(p.encode()))
            self.surface.append(b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else p.encode())
        s = SPACE_SYMBOL
        crossing = any(re.search(f"[^{s}]{s}", p) or ("\n" in p and len(p) > 1) for p in self.scores)
        self.words = re.compile(f".+" if crossing else rf"{s}*[^{s}\n]+|{s}+|\n", re.S).findall
        # Words seen of late and before: when the first table is full it takes the second one's place, so frequent words stay.
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def _merge(self, word: str) -> list[str]:
        """The word's pieces: the best-scored adjacent pair is merged first, of equal ones the leftmost."""
        scores, parts = self.scores, list(word)
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        none = float("-inf")
        pairs = list(map(scores.get, map(operator.add, parts, parts[1:]), itertools.repeat(none)))
        while pairs and (best := max(pairs)) > none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = scores.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = scores.get(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        n, scores, heap = len(parts), self.scores, []
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (s := scores.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not parts[i] or not parts[j] or right[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p]

    def _word(self, word: str) -> tuple[bytes, bytes]:
        """The word's ids and its pieces' normalised lengths in bytes, both packed."""
        ids, sizes = [], []
        for p in self._merge(word):
            if (i := self.ids.get(p)) is not None:
                ids.append(i)
                sizes.append(self.lengths[i])
            else:
                b = p.encode()
                ids += [self.byte_ids[x] for x in b]
                sizes += [0] * (len(b) - 1) + [len(b)]
        return struct.pack(f"<{len(ids)}I", *ids), struct.pack(f"<{len(sizes)}I", *sizes)

    def encode(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Ids with begin and end, packed little-endian; the pieces' source byte starts and ends."""
        norm, align = self.normalize(text.encode())
        known, found = self.known, []
        for w in self.words(norm.decode()):
            got = known.get(w)
            if got is None:
                got = self.older.get(w) or self._word(w)
                if len(w) <= LONG_WORD:
                    if len(known) >= REMEMBERED // 2:
                        self.known, self.older = {}, known
                        known = self.known
                    known[w] = got
            found.append(got)
        sizes = np.frombuffer(b"".join([s for _, s in found]), "<u4").astype(np.int64)
        ends = np.cumsum(sizes)
        starts, ends = align[ends - sizes], align[ends]
        first, last = np.zeros(1, np.int64), np.array([len(text.encode()) if text else 0])
        ids = struct.pack("<I", self.bos) + b"".join([i for i, _ in found]) + struct.pack("<I", self.eos)
        return ids, np.concatenate((first, starts, last)), np.concatenate((first, ends, last))

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, as the library's decode gives it."""
        out = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        space = SPACE_SYMBOL.encode()
        if self.normalize.dummy_prefix and out.startswith(space):
            out = out[len(space) :]
        return out.replace(space, b" ").decode("utf-8", "replace")


_models: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    """The model of a local file (one that every executor has, such as an installed package's)."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = PieceModel(f.read())
    return _models[path]


def _slices(batch: pa.RecordBatch, text_bytes: int = 4_000_000) -> Iterator[tuple[list, list]]:
    """The batch's (ids, texts) in runs of about so many bytes, so that outputs stay small."""
    keys, texts, size = [], [], 0
    for key, text in zip(batch.column(0), batch.column(1), strict=True):
        t = text.as_py() or ""
        keys.append(key.as_py())
        texts.append(t)
        size += len(t)
        if size >= text_bytes:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ids, starts, ends (binary, little-endian unsigned 32-bit), decoded (string).

    starts and ends are byte offsets in the original text; the begin and end ids have empty spans.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids binary, starts binary, ends binary, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            key_type = batch.schema.field(0).type
            for keys, texts in _slices(batch):
                coded = [model.encode(t) for t in texts]
                pack = lambda k: [x[k].astype("<u4").tobytes() for x in coded]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, key_type), pa.array([x[0] for x in coded], pa.binary()), pa.array(pack(1), pa.binary()), pa.array(pack(2), pa.binary()), pa.array([model.decode(x[0]) for x in coded], pa.string())],
                    names=[id_col, "ids", "starts", "ends", "decoded"],
                )

    return rows.mapInArrow(run, schema)


def digest(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The query's columns, derived from the operator's ids, spans and texts."""
    return coded.select(
        id_col,
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.concat("starts", "ends"), 256).alias("spans_sha256"),
    )
