"""Sum-of-squares online packing of token ids into windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder

#: Tokens of a full window.
WINDOW = 1024
END_ID = 0
#: Partly filled windows that a task holds at most: 16 MB of ids.
MOST_OPEN = 8192
#: Sequences of one task are numbered from its partition's number, shifted by this many bits.
_SHIFT = 36

#: (document, first id, ids): a stretch of one document. ``document`` is any value.
Piece = tuple[object, int, np.ndarray]


def least_squares_level(counts: np.ndarray, n: int) -> int:
    """The fill level whose window ``n`` more tokens should go to, 0 for a new one.

    ``counts[l]`` is the number of windows with l tokens, 0 for empty and full ones. A
    window that goes from l to l + n changes the sum of the counts' squares by
    2 * (counts[l + n] - counts[l] + 1); one less if l is empty or l + n is full, which
    aren't counted. The least sum wins, the fullest of equals."""
    levels = np.flatnonzero(counts[: len(counts) - n])[::-1]  # those that have a window with room, fullest first
    change = 2 * (counts[levels + n] - counts[levels] + 1)
    if len(levels) and levels[0] + n == len(counts) - 1:
        change[0] -= 1
    new = 2 * int(counts[n]) + (n < len(counts) - 1)
    best = int(np.argmin(change)) if len(levels) else -1
    return int(levels[best]) if best >= 0 and change[best] <= new else 0


def _is_power(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


class Windows:
    """Windows that aren't full, by fill level, and the sequences that are done."""

    def __init__(self, size: int = WINDOW) -> None:
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.at: list[list[list[Piece]]] = [[] for _ in range(size + 1)]
        self.open = 0
        self.done: list[list[Piece]] = []

    def add(self, document: object, ids: np.ndarray) -> None:
        """Whole windows are cut off; the rest is placed."""
        whole = len(ids) - len(ids) % self.size
        self.done += [[(document, at, ids[at : at + self.size])] for at in range(0, whole, self.size)]
        if n := len(ids) - whole:
            level = least_squares_level(self.counts, n)
            window = self.at[level].pop() if level else []
            window.append((document, whole, ids[whole:]))
            if level:
                self.counts[level] -= 1
                self.open -= 1
            if level + n == self.size:
                self.done.append(window)
            else:
                self.at[level + n].append(window)
                self.counts[level + n] += 1
                self.open += 1
            if self.open >= MOST_OPEN:
                self.settle()

    def settle(self) -> None:
        """End all open windows without padding. Those of 2**k tokens stay as they are.
        Of the others, the fullest are filled up from the emptiest, whose pieces are cut
        where they have to be; what is left in the end is parted into powers of two."""
        rest = []
        for level in range(self.size - 1, 0, -1):
            (self.done if _is_power(level) else rest).extend(self.at[level])
            self.at[level] = []
        self.counts[:] = 0
        self.open = 0
        fills = [sum(len(p[2]) for p in w) for w in rest]
        i, j = 0, len(rest) - 1
        while i < j:
            n = min(self.size - fills[i], fills[j])
            rest[i] += self._taken(rest[j], n)
            fills[i], fills[j] = fills[i] + n, fills[j] - n
            if fills[i] == self.size:
                self.done.append(rest[i])
                i += 1
            if not fills[j]:
                j -= 1
            elif _is_power(fills[j]) and i < j:
                self.done.append(rest[j])
                j -= 1
        if i == j and fills[i]:
            n = fills[i]
            while n:
                part = 1 << (n.bit_length() - 1)
                self.done.append(self._taken(rest[i], part))
                n -= part

    @staticmethod
    def _taken(window: list[Piece], n: int) -> list[Piece]:
        """The last ``n`` tokens of a window, taken out of it."""
        out = []
        while n:
            document, start, ids = window.pop()
            if len(ids) > n:
                keep = len(ids) - n
                window.append((document, start, ids[:keep]))
                document, start, ids = document, start + keep, ids[keep:]
            out.append((document, start, ids))
            n -= len(ids)
        return out[::-1]


def pack_online(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), a row for each piece:
    ``length`` ids of the document from its ``start``-th on (``ids``: little-endian unsigned
    32-bit), at ``offset`` of the sequence. ``doc_tokens`` counts the document's ids.

    A document is its text's ids and ``end_id``; a null text has only that. Each partition
    is packed by itself as its rows come, so nothing is shuffled, no key is hot and a task
    holds MOST_OPEN partly filled windows at most; if there are as many, and at the end,
    they are ended without padding (``Windows.settle``). A sequence has ``window`` tokens or
    a power of two. Its number is unique; it and the packing follow from how the table is
    dealt to partitions and in which order their rows come, and each way is a whole packing.
    Rows that repeat an id are packed each. Other columns are not read."""
    if not _is_power(window) or window > 1 << 16:
        raise ValueError("a window has a power of two tokens, 65,536 at most")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of_worker(tokenizer_path, 2)
        windows, number = Windows(window), TaskContext.get().partitionId() << _SHIFT
        end = end_id.to_bytes(2, "little")
        id_type = None

        def ended() -> pa.RecordBatch:
            nonlocal number
            pieces = [p for sequence in windows.done for p in sequence]
            sizes = np.fromiter(map(len, windows.done), np.int64, len(windows.done))
            sequence = np.repeat(np.arange(number, number + len(sizes)), sizes)
            number += len(sizes)
            windows.done = []
            length = np.fromiter((len(p[2]) for p in pieces), np.int64, len(pieces))
            until = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
            first = np.repeat(until[:-1][np.cumsum(sizes) - sizes], sizes)
            ids = np.concatenate([p[2] for p in pieces]).astype("<u4") if pieces else np.zeros(0, "<u4")
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(4 * until), pa.py_buffer(ids)])
            told = {
                "doc_id": pa.array([p[0][0] for p in pieces], id_type), "start": pa.array([p[1] for p in pieces], pa.int64()), "length": pa.array(length), "ids": raw.cast(pa.binary()),
                "doc_tokens": pa.array([p[0][1] for p in pieces], pa.int64()), "sequence_id": pa.array(sequence), "offset": pa.array(until[:-1] - first),
            }
            return pa.RecordBatch.from_arrays(list(told.values()), names=list(told))

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                ids = np.frombuffer(raw + end, "<u2")
                windows.add((doc_id, len(ids)), ids)
            yield ended()
        if id_type is not None:
            windows.settle()
            yield ended()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
