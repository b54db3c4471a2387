"""Packing of tokenised documents into sequences of a fixed length, best fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidelog.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
_SHIFT = 36


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaf c holds the windows with c free places.

    An inner node says whether anything lies below it, so that the tightest window with at least
    ``need`` free places is found in about 2 log2(size) steps.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: dict[int, list[int]] = {}

    def _add(self, free: int, n: int) -> None:
        i = free + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, window: int, free: int) -> None:
        self.at.setdefault(free, []).append(window)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest window with room for ``need``, removed: its number and its free places."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up, until a subtree to the right has one
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.leaves
        self._add(free, -1)
        return self.at[free].pop(), free


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece (of 1 to ``size`` tokens), and the number of windows."""
    window, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    tree = OpenWindows(size)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if (found := tree.take(n)) is None:
            w, free, used = used, size, used + 1
        else:
            w, free = found
        window[i], offset[i] = w, size - free
        if free > n:
            tree.put(w, free - n)
    return window, offset, used


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, the largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, block: int = 1 << 22) -> DataFrame:
    """Pieces of all documents, laid into sequences of at most ``size`` tokens.

    A document's tokens are its ids and ``end_id``. Documents of ``size`` tokens or more are first
    cut into full windows; the rest of each is packed best fit decreasing. Every task packs what it
    has read in blocks of about ``block`` tokens of rests, so nothing is shuffled, memory is
    bounded, and a task that is run again makes the same sequences. Of a block's windows those
    with more than a sixteenth left free, as its last ones, are dissolved: their pieces are laid
    behind one another, cut at the ends of full windows, and what remains goes into sequences
    whose lengths are powers of two, which need no padding. So how full sequences are doesn't
    depend on how much a task reads. Sequence ids are the task's number times 2**36 plus a count.

    Null and empty texts are one piece, the end id. Repeated rows are packed as often as they
    occur, a null doc_id stays null, an empty table gives no rows, and other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4")
        base, used = TaskContext.get().partitionId() << _SHIFT, 0
        rest: list[tuple] = []  # key, start, ids, tokens of the document
        kept = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        def piece(key: int | None, start: int, ids: np.ndarray, tokens: int, sequence: int, offset: int, total: int) -> tuple:
            return key, start, len(ids), zlib.crc32(ids.tobytes()), tokens, base + sequence, offset, total

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal used, kept
            if not rest:
                return
            lengths = np.array([len(r[2]) for r in rest])
            window, offset, n = best_fit_decreasing(lengths, size)
            total = np.bincount(window, lengths, n).astype(np.int64)
            tight = total >= size - size // 16
            number = used + np.cumsum(tight) - 1
            used += int(tight.sum())
            rows = [piece(*r, number[w], o, total[w]) for r, w, o in zip(rest, window.tolist(), offset.tolist(), strict=True) if tight[w]]
            loose = [r for r, w in zip(rest, window.tolist(), strict=True) if not tight[w]]
            left = int(total[~tight].sum())
            sequences = iter([size] * (left // size) + powers(left % size))
            most = at = 0
            for key, start, ids, tokens in loose:
                while len(ids):
                    if at == most:
                        most, at, used = next(sequences), 0, used + 1
                    part = ids[: most - at]
                    rows.append(piece(key, start, part, tokens, used - 1, at, most))
                    start, at, ids = start + len(part), at + len(part), ids[len(part) :]
            rest.clear()
            kept = 0
            yield out(rows)

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for at in range(0, len(keys), 256):
                full = []
                texts = batch.column("text").slice(at, 256).to_pylist()
                for key, ids in zip(keys[at : at + 256], enc.encode(texts), strict=True):
                    ids = np.concatenate([ids, end])
                    whole = len(ids) // size * size
                    for start in range(0, whole, size):
                        full.append(piece(key, start, ids[start : start + size], len(ids), used, 0, size))
                        used += 1
                    if whole < len(ids):
                        rest.append((key, whole, ids[whole:].copy(), len(ids)))
                        kept += len(ids) - whole
                if full:
                    yield out(full)
                if kept >= block:
                    yield from close()
        yield from close()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
