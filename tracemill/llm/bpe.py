"""Byte-level BPE encoding of a corpus with a public tokenizer's ranks.

The merges of a word run on a segment tree over the ranks of its adjacent pairs: the root is the leftmost of the lowest
ranks, a merge changes three leaves and their paths to the root, and the word is done when the root holds no pair. Texts
are cut before white space that follows other characters, where no token can span; each distinct piece is encoded once per
worker and its ids are kept as bytes, so most of a text is a lookup and a join of bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode's White_Space characters, as the tokenizers' patterns see them.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_ASCII_PIECE = re.compile(r"\s*\S+|\s+", re.A)
#: Distinct pieces a worker keeps, and the longest piece that is kept.
KEPT_PIECES, KEPT_LENGTH = 200_000, 48
#: Words of up to so many bytes are merged together, in so many cells at a time; longer ones have a tree of their own.
FOREST_WIDTH, FOREST_CELLS = 128, 1 << 20
_NONE = 1 << 62


class MergeTree:
    """A segment tree over the pairs of a word's parts; every node is the least (rank, position) below it, as one integer."""

    def __init__(self, parts: list[bytes], ranks: dict[bytes, int]):
        self.parts: list[bytes | None] = list(parts)
        self.ranks = ranks
        n = len(parts)
        self.next, self.before = list(range(1, n + 1)), list(range(-1, n - 1))
        self.width = 1 << max(0, (n - 1).bit_length())
        self.nodes = [_NONE] * (2 * self.width)
        for i in range(n - 1):
            self.nodes[self.width + i] = self._pair(i, i + 1)
        for k in range(self.width - 1, 0, -1):
            a, b = self.nodes[2 * k], self.nodes[2 * k + 1]
            self.nodes[k] = a if a < b else b

    def _pair(self, i: int, j: int) -> int:
        rank = self.ranks.get(self.parts[i] + self.parts[j])
        return _NONE if rank is None else rank << 32 | i

    def _put(self, i: int, value: int) -> None:
        nodes, k = self.nodes, self.width + i
        nodes[k] = value
        while k > 1:
            a, b = nodes[k], nodes[k ^ 1]
            k >>= 1
            least = a if a < b else b
            if nodes[k] == least:
                break
            nodes[k] = least

    def run(self) -> list[int]:
        n = len(self.parts)
        while (root := self.nodes[1]) != _NONE:
            i = root & 0xFFFFFFFF
            j = self.next[i]
            self.parts[i] += self.parts[j]
            self.parts[j] = None
            after = self.next[i] = self.next[j]
            self._put(j, _NONE)
            if after < n:
                self.before[after] = i
                self._put(i, self._pair(i, after))
            else:
                self._put(i, _NONE)
            if self.before[i] >= 0:
                self._put(self.before[i], self._pair(self.before[i], i))
        return [self.ranks[p] for p in self.parts if p is not None]


class MergeForest:
    """Segment trees of many short words at once: one column per word, the same steps as ``MergeTree`` over all columns."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def _pairs(self, left, right, position):
        import numpy as np

        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at] << 32 | position, _NONE)

    def run(self, words: list[bytes], width: int, dtype: str) -> list[bytes]:
        """The ids of words of 1 to ``width`` bytes (a power of two, at least 2), as bytes of ``dtype``."""
        import numpy as np

        count = len(words)
        lengths = np.fromiter(map(len, words), np.int64, count)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(count, width).T
        parts = self.first[raw]
        rows = np.arange(width, dtype=np.int64)[:, None]
        alive = rows < lengths
        after = np.repeat(rows + 1, count, axis=1)
        before = after - 2
        nodes = np.full((2 * width, count), _NONE, np.int64)
        nodes[width:2 * width - 1] = np.where(alive[1:], self._pairs(parts[:-1], parts[1:], rows[:-1]), _NONE)
        for k in range(width - 1, 0, -1):
            nodes[k] = np.minimum(nodes[2 * k], nodes[2 * k + 1])

        def put(position, column, value):
            k = position + width
            nodes[k, column] = value
            for _ in range(width.bit_length() - 1):
                k = k >> 1
                nodes[k, column] = np.minimum(nodes[2 * k, column], nodes[2 * k + 1, column])

        column = np.flatnonzero(nodes[1] != _NONE)
        while len(column):
            root = nodes[1, column]
            i = root & 0xFFFFFFFF
            j = after[i, column]
            parts[i, column] = root >> 32
            alive[j, column] = False
            following = after[j, column]
            after[i, column] = following
            put(j, column, _NONE)
            inside = following < lengths[column]
            safe = np.where(inside, following, 0)
            put(i, column, np.where(inside, self._pairs(parts[i, column], parts[safe, column], i), _NONE))
            before[following[inside], column[inside]] = i[inside]
            leading = before[i, column]
            has = leading >= 0
            p, at = leading[has], column[has]
            put(p, at, self._pairs(parts[p, at], parts[i[has], at], p))
            column = column[nodes[1, column] != _NONE]
        ids = parts.T[alive.T].astype(dtype).tobytes()
        ends = (np.cumsum(alive.sum(axis=0)) * np.dtype(dtype).itemsize).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Encodes texts with the ranks of a ``.tiktoken`` file and the word pattern that belongs to it."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}
        self.words = self.ascii_words = regex.compile(pattern).findall
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        if r"\p" not in plain:
            self.ascii_words = re.compile(plain, re.A).findall
        self.single = [bytes([b]) for b in range(256)]
        self.dtype = "<u2" if len(self.ranks) < 65_536 else "<u4"
        self.forest = MergeForest(self.ranks)
        self.pieces: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}

    def _encode_words(self, words: list[str]) -> None:
        import numpy as np

        by_width: dict[int, tuple[list[str], list[bytes]]] = {}
        for word in words:
            raw = word.encode("utf-8")
            texts, raws = by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), ([], []))
            texts.append(word)
            raws.append(raw)
        for width, (texts, raws) in by_width.items():
            if width > FOREST_WIDTH:
                for text, raw in zip(texts, raws, strict=True):
                    self.known_words[text] = np.array(MergeTree([self.single[b] for b in raw], self.ranks).run(), self.dtype).tobytes()
                continue
            step = FOREST_CELLS // width
            for start in range(0, len(texts), step):
                self.known_words.update(zip(texts[start:start + step], self.forest.run(raws[start:start + step], width, self.dtype), strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``dtype``."""
        cut = [(_ASCII_PIECE if t.isascii() else _PIECE).findall(t) for t in texts]
        new = set().union(*cut) - self.pieces.keys()
        if new:
            split = [(p, (self.ascii_words if p.isascii() else self.words)(p)) for p in new]
            words = set().union(*(w for _, w in split)) - self.known_words.keys()
            self._encode_words(list(words))
            get = self.known_words.__getitem__
            self.pieces.update((p, b"".join(map(get, w))) for p, w in split)
        get = self.pieces.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        if new:
            for p in new:
                if len(p) > KEPT_LENGTH:
                    del self.pieces[p]
            for w in words:
                if len(w) > KEPT_LENGTH:
                    del self.known_words[w]
            if len(self.pieces) > KEPT_PIECES:
                self.pieces.clear()
            if len(self.known_words) > KEPT_PIECES:
                self.known_words.clear()
        return out

    def encode(self, text: str | None) -> list[int]:
        import numpy as np

        return np.frombuffer(self.encode_batch([text])[0], self.dtype).tolist() if text else []


_ENCODERS: dict[int, Encoder] = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_corpus(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>), one row per row of ``df``; null and empty texts give an empty list, texts that hold the
    spelling of special tokens are ordinary text, repeated and null ids come out as they are, other columns are ignored.

    The rank file (below 1 MB, of fixed size) is read on the driver and broadcast; ``rank_path`` needn't exist on the workers.
    """
    shared = df.sparkSession.sparkContext.broadcast((read_ranks(rank_path), pattern))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        key = hash(shared.value)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(*shared.value)
        encoder = _ENCODERS[key]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = encoder.encode_batch([t or "" for t in part.column(1).to_pylist()])
                ids = np.frombuffer(b"".join(rows), encoder.dtype).astype(np.int32)
                size = np.dtype(encoder.dtype).itemsize
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) // size for r in rows], out=offsets[1:])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, "doc_id bigint, ids array<int>")
