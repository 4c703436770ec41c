"""Evaluation items that leak into a corpus: size-partitioned MinHash containment search, verified by exact shingles.

An item is a set of shingles of five words (of all its words, if it is shorter). What has to be found is a passage of 12 words, which
is eight neighbouring shingles, so an item of n shingles is sought at a containment of 8/n and a short one at 1. Items are partitioned
by their number of shingles, which sets the containment threshold. The sketch of a long item holds the MinHash of each of its
passages (neighbours mostly share it), that of a short one all its shingles. How much of a sketch stands among a document's
shingles estimates the containment; a leaked passage brings its MinHash along, so no threshold loses it. Candidates are
verified word by word: a sketched shingle and its neighbours must make up a whole passage.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.notebooks import cells
from tracemill.session import materialize

PASSAGE, SHINGLE = 12, 5
#: Bytes of item words (eight more for each) indexed and broadcast at a time; an index takes a few times as much. More items are
#: searched for in several blocks, each over all documents, which are decoded once.
BLOCK_BYTES, LIMIT_BYTES = 8 << 20, 256 << 20
#: Matches of shingles verified at a time.
_CHUNK = 50_000
_KEPT_LENGTH, _KEPT = 64, 300_000
_WORDS = None


def words(text: str) -> list[str]:
    """Maximal runs of Unicode letters and digits, in lower case."""
    global _WORDS
    if _WORDS is None:
        import regex

        _WORDS = regex.compile(r"[\p{L}\p{Nd}]+").findall
    return [w.lower() for w in _WORDS(text)]


def _shingles(ids, starts, width: int):
    """64-bit hashes of the ``width`` word ids at each of ``starts``."""
    import numpy as np

    h = np.full(len(starts), 0x243F6A8885A308D3, np.uint64)
    for k in range(width):
        h = (h ^ ids[starts + k].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return h


def _sketched(hashes, span: int):
    """Positions of the MinHash of every run of ``span`` shingles; of equal ones the first."""
    import numpy as np

    runs = np.lib.stride_tricks.sliding_window_view(hashes, span)
    return np.unique(np.arange(len(runs)) + runs.argmin(axis=1))


class ContainmentIndex:
    """Sketches of a block of items. Shingles of equal width share one sorted table of (hash, item, position)."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        import numpy as np

        self.ids: dict[str, int] = {}
        self.items = np.array([item for item, _ in items], np.int64)
        gap, texts, at = [-1] * PASSAGE, [[-1] * PASSAGE], PASSAGE
        found: dict[int, list] = {}
        sizes, shingles = np.zeros(len(items), np.int32), np.zeros(len(items), np.int32)
        self.passage = np.zeros(len(items), np.int32)
        for k, (_, own) in enumerate(items):
            numbers = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in own], np.int32)
            width = min(SHINGLE, len(numbers))
            if width:
                hashes = _shingles(numbers, np.arange(len(numbers) - width + 1), width)
                self.passage[k], shingles[k] = min(PASSAGE, len(numbers)), len(hashes)
                places = _sketched(hashes, PASSAGE - SHINGLE + 1) if len(numbers) >= PASSAGE else np.unique(hashes, return_index=True)[1]
                sizes[k] = len(np.unique(hashes[places]))
                found.setdefault(width, []).append((hashes[places], np.full(len(places), k, np.int32), (at + places).astype(np.int32)))
            texts += [numbers, gap]
            at += len(numbers) + PASSAGE
        self.text = np.concatenate([np.asarray(x, np.int32) for x in texts])
        # partitions by the size of the shingle set; within one, the largest sketch sets the containment that is asked for
        partition = np.where(self.passage < PASSAGE, -1, np.ceil(np.log2(np.maximum(shingles, 1))).astype(np.int32))
        self.needed = sizes.copy()
        for p in np.unique(partition[partition >= 0]):
            mine = partition == p
            self.needed[mine] = np.maximum(1, np.ceil(sizes[mine] / sizes[mine].max()))
        self.tables = {}
        for width, parts in found.items():
            hashes, owners, positions = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            unique, first, counts = np.unique(hashes[order], return_index=True, return_counts=True)
            self.tables[width] = (unique, first, counts, owners[order], positions[order])

    @property
    def nbytes(self) -> int:
        """Bytes of the tables and about those of the vocabulary."""
        return self.text.nbytes + sum(x.nbytes for t in self.tables.values() for x in t) + sum(len(w) + 120 for w in self.ids)

    def search(self, ids, owners) -> set[tuple[int, int]]:
        """(item, owner) for word ids, 0 being any word of no item; ``owners`` numbers the text that each word is from.

        ``ids`` begins and ends with PASSAGE zeros, and a zero stands between texts.
        """
        import numpy as np

        found: set[tuple[int, int]] = set()
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for width, (unique, first, counts, item_of, position_of) in self.tables.items():
            starts = np.flatnonzero(unknown[width:] == unknown[:-width])
            if not len(starts):
                continue
            hashes = _shingles(ids, starts, width)
            at = np.minimum(np.searchsorted(unique, hashes), len(unique) - 1)
            hit = unique[at] == hashes
            starts, at = starts[hit], at[hit]
            if not len(starts):
                continue
            # the share of each sketch that a text holds, from its distinct shingles
            distinct = np.unique(owners[starts].astype(np.int64) * len(unique) + at)
            text, shingle = distinct // len(unique), distinct % len(unique)
            pairs = np.repeat(text, counts[shingle]) * len(self.items) + item_of[_spans(first[shingle], counts[shingle])]
            # a sketch may hold a shingle at two positions of its item
            pairs = np.unique(np.stack([pairs, np.repeat(shingle, counts[shingle])]), axis=1)[0] if len(pairs) else pairs
            candidates, held = np.unique(pairs, return_counts=True)
            candidates = candidates[held >= self.needed[candidates % len(self.items)]]
            ends = np.cumsum(counts[at])
            for low in range(0, int(ends[-1]), _CHUNK):
                # matches of a text's shingle with every place of it in the items, a bounded number at a time
                index = np.arange(low, min(low + _CHUNK, int(ends[-1])))
                which = np.searchsorted(ends, index, "right")
                posting = first[at[which]] + index - (ends[which] - counts[at[which]])
                place, item = starts[which], item_of[posting]
                key = owners[place].astype(np.int64) * len(self.items) + item
                keep = candidates[np.minimum(np.searchsorted(candidates, key), max(len(candidates) - 1, 0))] == key if len(candidates) else np.zeros(len(key), bool)
                key, place, item, position = key[keep], place[keep], item[keep], position_of[posting[keep]]
                right = _run(ids, self.text, place, position, 1)
                left = _run(ids, self.text, place - 1, position - 1, -1)
                for k in np.unique(key[left + right >= self.passage[item]]).tolist():
                    found.add((int(self.items[k % len(self.items)]), k // len(self.items)))
                candidates = candidates[~np.isin(candidates, key[left + right >= self.passage[item]])]
                if not len(candidates):
                    break
        return found


def _spans(first, counts):
    """The indices first, first + 1, ... of each span, one after another."""
    import numpy as np

    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(first, counts)


def _run(a, b, at, other, step: int):
    """How many words of ``a`` from ``at`` on agree with those of ``b`` from ``other`` on, up to PASSAGE."""
    import numpy as np

    same, length = np.ones(len(at), bool), np.zeros(len(at), np.int32)
    for k in range(PASSAGE):
        same &= a[at + k * step] == b[other + k * step]
        length += same
    return length


def _pieces(own: list[str]) -> Iterator[tuple[list[str], int]]:
    """A long item in overlapping pieces that hold all its passages, each with its size in bytes."""
    start = size = 0
    for end, word in enumerate(own):
        if size + len(word) + 8 > BLOCK_BYTES and end - start > 2 * PASSAGE:
            yield own[start:end], size
            start = end - PASSAGE + 1
            size = sum(len(w) + 8 for w in own[start:end])
        size += len(word) + 8
    if own[start:]:
        yield own[start:], size


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for row in items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).filter("item_id IS NOT NULL").toLocalIterator():
        for piece, n in _pieces(words(row.text or "")):
            if block and size + n > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append((row.item_id, piece))
            size += n
    if block:
        yield block


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n".join(x for _, x in cells(text, nb_format)) for text, nb_format in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.nulls(len(texts), pa.string())], ["doc_id", "text", "nb_format"])


def _shared(docs: DataFrame, items: list[tuple[int, list[str]]]):
    index = ContainmentIndex(items)
    if index.nbytes > LIMIT_BYTES:
        raise ValueError(f"an index of {index.nbytes} bytes is too large to broadcast")
    return docs.sparkSession.sparkContext.broadcast(index)


def _search(docs: DataFrame, shared) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        index: ContainmentIndex = shared.value
        vocabulary, known = index.ids, {}
        margin = b"\0\0\0\0" * PASSAGE
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                doc_ids, texts, formats = (part.column(i).to_pylist() for i in range(3))
                pieces, lengths = [margin], [PASSAGE]
                for text, nb_format in zip(texts, formats, strict=True):
                    own = []
                    for token in "\n".join(x for _, x in cells(text, nb_format)).split():
                        ids = known.get(token)
                        if ids is None:
                            ids = np.array([vocabulary.get(w, 0) for w in words(token)], np.int32).tobytes()
                            if len(token) <= _KEPT_LENGTH:
                                if len(known) >= _KEPT:
                                    known.clear()
                                known[token] = ids
                        own.append(ids)
                    own.append(b"\0\0\0\0")
                    pieces.append(b"".join(own))
                    lengths.append(len(pieces[-1]) // 4)
                pieces.append(margin)
                lengths.append(PASSAGE)
                ids = np.frombuffer(b"".join(pieces), np.int32)
                pairs = sorted(index.search(ids, np.repeat(np.arange(-1, len(lengths) - 1), lengths)))
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([doc_ids[d] for _, d in pairs], pa.int64())], ["item_id", "doc_id"])

    return docs.mapInArrow(search, "item_id bigint, doc_id bigint")


def leaked(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, doc_id: every document holding 12 consecutive words of an item, or all of a shorter item; each pair once.

    Documents need ``doc_id``, ``text`` and ``nb_format``; the words of all their cells count, in order. Items without words or
    with a null id match nothing, null and empty texts hold nothing, documents with a null id are kept, other columns are ignored.
    Items reach the workers in blocks of bounded size, and every block is searched for in all documents.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "nb_format")
    blocks = _blocks(items, item_id, item_text)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint")
    if second is None:
        return _search(docs, _shared(docs, first)).distinct()
    docs = materialize(docs.mapInArrow(_decoded, "doc_id bigint, text string, nb_format string"), "decoded")
    found = []
    for block in itertools.chain([first, second], blocks):
        # one block's index at a time is held anywhere
        shared = _shared(docs, block)
        found.append(materialize(_search(docs, shared).distinct(), "leaks"))
        shared.destroy()
    return reduce(DataFrame.unionByName, found).distinct()
