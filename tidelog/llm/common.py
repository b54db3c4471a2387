"""What several operators share: texts as bytes, and hashes of words and of word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# --------------------------------------------------------------------------- words

_CHUNK = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(_CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES["up"] = _powers(_BASE)
        _TABLES["down"] = _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)))
    return _TABLES["up"], _TABLES["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(buf: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs without white space; a run also ends at each of ``breaks``."""
    solid = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    b = breaks[breaks < len(buf)]
    start[b] = solid[b]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    b = breaks[(breaks > 0) & (breaks <= len(buf))] - 1
    end[b] = solid[b]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _hash_chunk(buf: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    up, down = _tables()
    if lower:
        buf = buf | (((buf >= 65) & (buf <= 90)).view(np.uint8) << 5)
    starts, ends = _spans(buf, breaks)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _word_end(buf: np.ndarray, at: int, most: int) -> int:
    while at < most:
        part = buf[at : min(most, at + _CHUNK)]
        gap = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
        if len(gap):
            return at + int(gap[0])
        at += len(part)
    return most


def _hash_long(buf: np.ndarray, at: int, end: int, lower: bool) -> np.ndarray:
    """Of a word over several chunks, from the hashes of its chunks in turn."""
    h = np.zeros(1, np.uint64)
    for i in range(at, end, _CHUNK):
        part, _ = _hash_chunk(buf[i : min(end, i + _CHUNK)], np.zeros(1, np.int64), lower)
        h = mix(h * _BASE + part[:1])
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column behind one another, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]] if len(offsets) else buf[:0], offsets - offsets[0]


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text, and the n + 1 word offsets.

    A polynomial in the bytes, by prefix sums, so that no word is looked at by itself. Works in
    chunks of about 2 MB; a word longer than that is hashed from the hashes of its parts.
    """
    parts, places, at, n = [], [], 0, len(buf)
    while at < n:
        to = min(n, at + _CHUNK)
        if to < n:  # go back to a place between words
            last = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[last] > at:
                to = int(offsets[last])
            else:
                tail = buf[at:to]
                gap = np.flatnonzero((tail == 32) | ((tail >= 9) & (tail <= 13)))
                if not len(gap):  # inside one word of more than a chunk
                    parts.append(_hash_long(buf, at, end := _word_end(buf, to, int(offsets[last + 1])), lower))
                    places.append(np.array([at]))
                    at = end
                    continue
                to = at + int(gap[-1]) + 1
        lo, hi = np.searchsorted(offsets, [at, to], "left")
        h, starts = _hash_chunk(buf[at:to], offsets[lo : hi + 1] - at, lower)
        parts.append(h)
        places.append(starts + at)
        at = to
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    where = np.concatenate(places)
    return np.concatenate(parts), np.searchsorted(where, offsets, "left").astype(np.int64)


_MULT = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words of a flat array, also across the borders of texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _MULT[0]
    for i in range(1, k):
        out += words[i : i + n] * _MULT[i]
    return mix(out)


def text_batches(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``most`` bytes together, for bounded memory."""
    _, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)
