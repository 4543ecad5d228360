"""Harmonic packing of token sequences, each worker for itself.

Class j holds lengths in (capacity / (j + 1), capacity / j], j documents to a sequence; the last class
holds all shorter ones, as many as fit. Only what a document has above the capacity is cut off, into
full sequences. A sequence that has its documents waits, with the gap it has left, until a document comes
that fits into the gaps that wait: that one is cut over them. Gaps of less than 1/128 are padded. What a
worker has left at its end is cut freely into full sequences, and the last of those into sequences of a
power of two, which need no padding. Nothing is shuffled, a worker holds one sequence a class and less
than a sequence's worth of gaps; a sequence_id holds the partition's number above 40 bits.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from covaria.llm.bpe import byte_symbols
from covaria.llm.common import arrow_map, table, utf8_rows

CAPACITY = 2048
#: Classes of lengths; the last holds all that are no longer than a CLASSES-th of a sequence.
CLASSES = 16
END = 1
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


class Ids:
    """Token ids of texts as little-endian uint32 bytes, as the tokenizers library has them for the file.

    The file's vocabulary (ids are ranks) also drives tiktoken, which gives the same ids several times
    faster. What the two might treat unlike goes to tokenizers: special strings, characters beyond
    Latin (their Unicode tables differ) and control characters that only one takes for white space.
    """

    def __init__(self, path: str):
        import json
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.tokens = Tokenizer.from_file(path)
        self.tokens.no_truncation()
        self.tokens.no_padding()
        of = {c: b for b, c in enumerate(byte_symbols())}
        special = {x["content"] for x in json.loads(self.tokens.to_str())["added_tokens"]}
        ranks = {bytes(map(of.__getitem__, t)): i for t, i in self.tokens.get_vocab(with_added_tokens=False).items() if t not in special}
        #: Fixed value: the pre-token pattern of byte-level vocabularies.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.odd = re.compile(r"<\||[^\t\n\r -~\u00a1-\u024f]")

    def __call__(self, text: str) -> bytes:
        ids = self.tokens.encode(text, add_special_tokens=False).ids if self.odd.search(text) else self.fast(text)
        return array("I", ids).tobytes()


class Packer:
    """One worker's packing: add() documents, then end(); both give the pieces that have got their place."""

    def __init__(self, worker: int, capacity: int = CAPACITY, classes: int = CLASSES):
        self.next, self.capacity, self.classes, self.slack = worker << 40, capacity, min(classes, capacity), capacity // 128
        #: of each class, the pieces (doc_id, start, ids, doc_tokens) of the sequence being filled
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.waiting: deque[tuple[list[tuple], int]] = deque()  # pieces, gap
        self.room = 0

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next, at
            at += len(ids) // 4
        self.next += 1

    def _done(self, pieces: list[tuple]) -> Iterator[tuple]:
        """A sequence that has its documents: placed, or made to wait for its gap to be filled."""
        gap = self.capacity - sum(len(p[2]) // 4 for p in pieces)
        if gap <= self.slack:
            yield from self._close(pieces)
        else:
            self.waiting.append((pieces, gap))
            self.room += gap

    def _pour(self, doc_id: int | None, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        """Cuts a document over the gaps that wait."""
        while ids:
            pieces, gap = self.waiting.popleft()
            n = min(gap, len(ids) // 4)
            pieces.append((doc_id, start, ids[: 4 * n], total))
            start, ids, gap = start + n, ids[4 * n :], gap - n
            self.room -= n
            if gap <= self.slack:
                self.room -= gap
                yield from self._close(pieces)
            else:
                self.waiting.appendleft((pieces, gap))

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total, at = len(ids) // 4, 0
        while total - at >= self.capacity:
            yield from self._close([(doc_id, at, ids[4 * at : 4 * (at + self.capacity)], total)])
            at += self.capacity
        left = total - at
        if not left:
            return
        if left <= self.room:
            yield from self._pour(doc_id, at, ids[4 * at :], total)
            return
        j = min(self.capacity // left, self.classes)
        if j == self.classes and sum(len(p[2]) // 4 for p in self.open[j]) + left > self.capacity:
            yield from self._done(self.open.pop(j))
        self.open[j].append((doc_id, at, ids[4 * at :], total))
        if j < self.classes and len(self.open[j]) == j:
            yield from self._done(self.open.pop(j))

    def end(self) -> Iterator[tuple]:
        left = deque(p for pieces in (*(x for x, _ in self.waiting), *(self.open[j] for j in sorted(self.open))) for p in pieces)
        self.open.clear()
        self.waiting.clear()
        self.room = 0
        tokens = sum(len(p[2]) // 4 for p in left)
        while tokens:
            size = min(self.capacity, 1 << (tokens.bit_length() - 1))
            now, room = [], size
            while room:
                doc_id, start, ids, total = left.popleft()
                n = min(room, len(ids) // 4)
                now.append((doc_id, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    left.appendleft((doc_id, start + n, ids[4 * n :], total))
                room -= n
            yield from self._close(now)
            tokens -= size


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty: its document is the end id alone. Every id lies in exactly one piece. Repeated
    rows are packed each; a null doc_id stays null; other columns are ignored; an empty table gives an
    empty result. Documents of equal length are placed in the order they come; one longer than the
    capacity fills whole sequences first. capacity must be a power of two.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    end = end_id.to_bytes(4, "little")

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer, ready = Ids(path), Packer(TaskContext.get().partitionId(), capacity), []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1)), strict=True):
                ready += packer.add(doc_id, ids(text.decode()) + end)
                if len(ready) > 20_000:
                    yield rows(ready)
                    ready = []
        ready += packer.end()
        if ready:
            yield rows(ready)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").transform(arrow_map, run, _SCHEMA)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
