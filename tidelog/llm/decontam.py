"""Benchmark passages in documents: SimHash of windows, multi-index Hamming search, exact verification.

A window of an item's length whose weighted Jaccard with the item is at least ``least`` lacks
shingles of at most 1 - ``least`` of the item's weight. So of any shingles of more weight than that
it has at least one; each item gives fingerprints of such a set, its heaviest, and documents are
looked at from every word for them. What has one is compared with the item at every place that
holds it, so nothing of at least ``least`` is missed, however its words were changed. An item of
fewer than five words is one shingle, its whole word sequence, and is looked for as such.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import mix, shingle_hashes, text_batches, utf8, word_hashes
from tidelog.llm.files import new_file, open_fs
from tidelog.stage import Stage

FOUND = "doc_id long, item_id long, similarity double, first_word long, n_windows long"
SHINGLE = 5
_PART = 1 << 17


def simhash(words: np.ndarray, starts: np.ndarray, length: int, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit SimHash of the ``length`` words from each of ``starts`` on; features are pairs of words."""
    if sums is None:
        sums = bit_sums(words)
    n = length - 1
    ones = sums[starts + n] - sums[starts]  # up to 255 of them: exact in wrapping 8-bit sums
    return np.packbits(ones > n // 2, axis=1).view(np.uint64).reshape(-1)


def bit_sums(words: np.ndarray) -> np.ndarray:
    """Running sums, modulo 256, of each bit of the hashes of word pairs."""
    pairs = shingle_hashes(words, 2)
    sums = np.zeros((len(pairs) + 1, 64), np.uint8)
    np.cumsum(np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint8, out=sums[1:])
    return sums


class HammingIndex:
    """Fingerprints by each of radius + 1 blocks of their bits.

    Two fingerprints that differ in at most ``radius`` bits agree in at least one block, so looking
    up every block of a query finds all fingerprints within the radius.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        cuts = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            shift, mask = np.uint64(a), np.uint64((1 << int(b - a)) - 1)
            value = ((prints >> shift) & mask).astype(np.int64)
            order = np.argsort(value, kind="stable")
            if b - a <= 22:
                first = np.searchsorted(value[order], np.arange((1 << int(b - a)) + 1))
            else:
                first = None
            self.blocks.append((shift, mask, value[order], order, first))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in queries, position in the prints) within the radius, each once."""
        rows, hits = [], []
        for shift, mask, value, order, first in self.blocks:
            q = ((queries >> shift) & mask).astype(np.int64)
            if first is None:
                lo, hi = np.searchsorted(value, q), np.searchsorted(value, q, "right")
            else:
                lo, hi = first[q], first[q + 1]
            some = np.flatnonzero(hi > lo)
            for at in range(0, len(some), 1 << 16):
                part = some[at : at + (1 << 16)]
                n = hi[part] - lo[part]
                row = np.repeat(part, n)
                hit = order[np.arange(len(row)) - np.repeat(np.cumsum(n) - n - lo[part], n)]
                ok = np.bitwise_count(queries[row] ^ self.prints[hit]) <= self.radius
                rows.append(row[ok])
                hits.append(hit[ok])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(rows) * len(self.prints) + np.concatenate(hits))
        return both // len(self.prints), both % len(self.prints)


@dataclass
class Item:
    item_id: int
    words: np.ndarray


@dataclass
class Weights:
    """Weights of shingles by how many of all items have them: of those that several have; others weigh ``rare``."""

    rare: float
    known: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, n_items: int, shingles: np.ndarray, counts: np.ndarray) -> Weights:
        order = np.argsort(shingles)
        return cls(math.log(1 + n_items), shingles[order], np.log(1 + n_items / counts[order]))

    def weigh(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(shingles), self.rare)
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, self.weights[at], self.rare)


def _hashes(words: np.ndarray) -> np.ndarray:
    """Five-word shingles; of fewer words the whole sequence as one."""
    n = len(words)
    return shingle_hashes(words, SHINGLE) if n >= SHINGLE else _short(words, n)


def _short(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n words, n below five."""
    return mix(shingle_hashes(words, n) + np.uint64(n))


def _shingles(words: np.ndarray) -> Counter:
    return Counter(_hashes(words).tolist())


def similarity(a: Counter, b: Counter, weight: dict[int, float], other: float) -> float:
    """Weighted Jaccard of two multisets of shingles; those without a weight weigh ``other``."""
    both = sum(weight.get(s, other) * min(n, b[s]) for s, n in a.items() if s in b)
    every = sum(weight.get(s, other) * max(a[s], b[s]) for s in a.keys() | b.keys())
    return both / every if every else 0.0


class Searcher:
    """Items in classes of window lengths, each class with a Hamming index of its fingerprints.

    Documents are looked at in windows of a class's length, nearly its items' own, every ``step``
    words. An item has a fingerprint for each of the ``step`` places at which such a grid can cut
    it, leaving out its first and last word, so an unchanged passage always meets one of them at
    distance 0 wherever it lies. The radius, which grows with the windows, allows for words that
    differ inside.

    Those few windows may all be changed in a passage that is still similar enough. The first class
    has windows of one shingle, looked for from every word at distance 0: of each item the heaviest
    that together weigh more than 1 - ``least`` of it, one of which every such passage has.
    Items of fewer than five words are in none of these: they are looked up by their length's own
    shingles, from every word.
    """

    def __init__(self, items: list[Item], least: float = 0.8, weights: Weights | None = None):
        self.items, self.least = items, least
        self.shingles = [_shingles(item.words) for item in items]
        if weights is None:  # these are all items
            seen = Counter(s for c in self.shingles for s in c)
            weights = Weights.of(len(items), np.array(list(seen), np.uint64), np.array(list(seen.values()), np.int64))
        self.weights = weights
        self.own = []  # each item's shingles, sorted; how often it has each; its weight
        for c in self.shingles:
            own = np.array(sorted(c), np.uint64)
            count = np.array([c[s] for s in own.tolist()], np.int64)
            self.own.append((own, count, float(weights.weigh(own) @ count)))
        by: dict[int, list[int]] = {}
        brief: dict[int, list[int]] = {}
        for i, item in enumerate(items):
            n = len(item.words)
            (by.setdefault(self._length(n), []) if n >= SHINGLE else brief.setdefault(n, [])).append(i)
        self.brief = []  # of each length below five: the items' hashes in order, and whose they are
        for n, members in sorted(brief.items()):
            hashes = np.array([self.own[i][0][0] for i in members], np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.brief.append((n, hashes[order], np.array(members)[order]))
        self.classes = []
        if by:
            full = sorted(i for members in by.values() for i in members)
            places = [self._needed(i) for i in full]
            owner = np.repeat(np.array(full), [len(at) for at in places])
            prints = [simhash(items[i].words, at, SHINGLE) for i, at in zip(full, places, strict=True)]
            self.classes.append((SHINGLE, 1, owner, np.concatenate(places), HammingIndex(np.concatenate(prints), 0)))
        for length, members in sorted(by.items()):
            least = min(len(items[i].words) for i in members)
            edge = 1 if least > length + 1 else 0
            step = least - 2 * edge - length + 1
            owner, offset, prints = [], [], []
            for i in members:
                at = np.arange(edge, edge + step)
                prints.append(simhash(items[i].words, at, length))
                owner += [i] * step
                offset += at.tolist()
            self.classes.append((length, step, np.array(owner), np.array(offset), HammingIndex(np.concatenate(prints), max(3, min(8, length // 6)))))

    def _needed(self, item: int) -> np.ndarray:
        """Places of the item's heaviest shingles that weigh more than a similar window can lack."""
        own, count, every = self.own[item]
        _, first = np.unique(shingle_hashes(self.items[item].words, SHINGLE), return_index=True)
        weight = self.weights.weigh(own)
        order = np.lexsort((first, -weight))
        enough = np.cumsum((weight * count)[order]) > (1 - self.least + 1e-6) * every
        return first[order[: int(np.argmax(enough)) + 1 if enough.any() else len(order)]]

    @staticmethod
    def _length(n: int) -> int:
        """The longest of about 5, 6, 8, 11, 14, ... words that leaves two edge words and a step."""
        most = min(200, n - 2 - max(2, n // 6))
        if most < 5:
            return n
        length = 5
        while (longer := math.ceil(length * 1.28)) <= most:
            length = longer
        return length

    def find(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """For each item in a document: best similarity, its first word, and how many windows had it."""
        _, start, item = self.candidates(words)
        return self._best(words, start, item) | {i: (1.0, first, n) for i, first, n in self.whole(words, np.array([0, len(words)]))[0]}

    def whole(self, words: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each text, of the items of fewer than five words that it holds: the item, its first word there, how often."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in at[1:]]
        for n, hashes, members in self.brief:
            found = _short(words, n)
            lo = np.searchsorted(hashes, found)
            place = np.flatnonzero(np.append(hashes, np.uint64(0))[lo] == found)
            place = place[lo[place] < len(hashes)]
            doc = np.searchsorted(at, place, "right") - 1
            inside = place + n <= at[doc + 1]
            place, doc = place[inside], doc[inside]
            _, first, times = np.unique(doc * (len(hashes) + 1) + lo[place], return_index=True, return_counts=True)
            for a, b in zip(first.tolist(), times.tolist(), strict=True):
                h = found[place[a]]
                for i in members[np.searchsorted(hashes, h) : np.searchsorted(hashes, h, "right")].tolist():
                    out[int(doc[a])].append((i, int(place[a] - at[doc[a]]), b))
        return out

    def _best(self, words: np.ndarray, start: np.ndarray, item: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Of the items that candidates name, what all windows about them have."""
        best: dict[int, tuple[float, int, int]] = {}
        order = np.lexsort((start, item))
        start, item = start[order], item[order]
        reach = np.array([len(self.items[i].words) - SHINGLE for i in item.tolist()], np.int64)
        # windows that hold the same shingle begin within reach; where such ranges meet they are one
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (start[1:] - start[:-1] > 2 * reach[1:])
        first = np.flatnonzero(new)
        last = np.append(first, len(item))[1:] - 1
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            i = int(item[a])
            similar, where, n = self._verify(words, int(start[a] - reach[a]), int(start[b] + reach[b]), i)
            if n:
                old = best.get(i, (0.0, 0, 0))
                best[i] = (*((similar, where) if similar > old[0] else old[:2]), old[2] + n)
        return best

    def _verify(self, words: np.ndarray, lo: int, hi: int, item: int) -> tuple[float, int, int]:
        """Best similarity of windows that begin from ``lo`` to ``hi``, its first word, and how many are similar enough.

        Windows are cut to the document. What a shingle of the item adds to a window's common weight
        starts with the first window that holds it, unless that one has all of the item's already.
        """
        own, count, every = self.own[item]
        n = len(self.items[item].words)
        m = n - SHINGLE + 1
        lo, hi = max(lo, 1 - m), min(hi, len(words) - SHINGLE)
        if hi < lo:
            return 0.0, 0, 0
        begin = max(0, lo)
        found = shingle_hashes(words[begin : hi + n], SHINGLE)
        at = np.minimum(np.searchsorted(own, found), len(own) - 1)
        place = np.flatnonzero(own[at] == found)
        if not len(place):
            return 0.0, 0, 0
        weight = self.weights.weigh(found)
        kind, place = at[place], place + begin
        order = np.argsort(kind, kind="stable")
        kind, place = kind[order], place[order]
        earlier = np.arange(len(kind)) - count[kind]
        full = (earlier >= 0) & (kind[earlier] == kind)
        since = np.where(full, np.maximum(place - m, place[earlier]), place - m) + 1
        since, until = np.maximum(since, lo), np.minimum(place, hi) + 1
        some = since < until
        steps = np.zeros(hi - lo + 2)
        np.add.at(steps, since[some] - lo, weight[place[some] - begin])
        np.add.at(steps, until[some] - lo, -weight[place[some] - begin])
        both = np.cumsum(steps)[:-1]
        sums = np.concatenate([[0.0], np.cumsum(weight)])
        starts = np.arange(lo, hi + 1)
        whole = sums[np.minimum(starts + m - begin, len(weight))] - sums[np.maximum(starts, begin) - begin]
        similar = both / (every + whole - both)
        # cut windows at the start of a document begin with its first word
        enough = int((similar >= self.least - 1e-9).sum())
        if not enough:
            return 0.0, 0, 0
        start = lo + int(np.flatnonzero(similar >= similar.max() - 1e-9)[0])
        window = _shingles(words[max(0, start) : start + n])
        every = np.array(list(window.keys() | self.shingles[item].keys()), np.uint64)
        exact = similarity(window, self.shingles[item], dict(zip(every.tolist(), self.weights.weigh(every).tolist(), strict=True)), self.weights.rare)
        return exact, max(0, start), enough

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose fingerprints lie within the radius: their first words, those of the passages, items."""
        found = [np.zeros((3, 0), np.int64)]
        for at in range(0, len(words) if self.classes else 0, _PART):
            part = words[at : at + _PART + 256]
            if len(part) < 2:
                continue
            sums = bit_sums(part)
            for length, step, owner, offset, index in self.classes:
                starts = np.arange(0, min(_PART, len(part) - length + 1), step)
                if len(starts):
                    row, hit = index.near(simhash(part, starts, length, sums))
                    found.append(np.stack([starts[row] + at, starts[row] + at - offset[hit], owner[hit]]))
        place, start, item = np.concatenate(found, axis=1)
        return place, start, item


def _lower(texts: pa.Array) -> pa.Array:
    """What items and documents alike are put into lower case by."""
    return pa.compute.utf8_lower(texts)


def _items(ids: list[int], texts: pa.Array) -> list[Item]:
    words, at = word_hashes(*utf8(_lower(texts)))
    return [Item(i, words[a:b].copy()) for i, a, b in zip(ids, at[:-1].tolist(), at[1:].tolist(), strict=True) if b > a]


@dataclass
class Lots:
    """Items as files in the shared folder, at most a lot in each, and the weights of all items' shingles."""

    paths: list[str]
    least: float
    weights: Broadcast[Weights]

    def searcher(self, i: int) -> Searcher:
        store, local = open_fs(self.paths[i])
        with store.open_input_stream(local) as file, pa.ipc.open_stream(file) as stream:
            rows = stream.read_all().combine_chunks()
        return Searcher(_items(rows.column("item_id").to_pylist(), rows.column("text").combine_chunks()), self.least, self.weights.value)

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[dict[int, list[tuple]]]]]:
        """Each batch with what was found in each of its documents, by item_id.

        A single lot is set up once for a task. Several take turns at each batch, so documents are
        read once and one lot is held at a time.
        """
        one = self.searcher(0) if len(self.paths) == 1 else None
        for batch in batches:
            found: list[dict[int, list[tuple]]] = [{} for _ in range(batch.num_rows)]
            for i in range(len(self.paths)):
                searcher = one or self.searcher(i)
                for doc, best in _hits(searcher, batch):
                    for item, what in best.items():
                        key = searcher.items[item].item_id
                        found[doc].setdefault(key, []).append(what)  # several texts may have one item_id
            yield batch, found


def _lots(items: DataFrame, least: float, lot: int) -> Lots:
    spark = items.sparkSession
    stage = Stage(spark, "items")
    rows = stage.save(items.select("item_id", "text").filter("text is not null").dropDuplicates(["item_id", "text"]), "items")
    folder = stage.path("lots")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = 0
        for batch in batches:
            for at in range(0, batch.num_rows, lot):
                with new_file(folder, f"lot-{no}") as (stream, path), pa.ipc.new_stream(stream, batch.schema) as out:
                    out.write_batch(batch.slice(at, lot))
                no += 1
                yield pa.RecordBatch.from_pydict({"path": [path]})

    parts = max(1, -(-rows.count() // lot))
    paths = [r.path for r in stage.save(rows.repartition(parts).mapInArrow(write, "path string"), "paths").collect()]
    return Lots(sorted(paths), least, spark.sparkContext.broadcast(_weights(rows)))


def _weights(rows: DataFrame) -> Weights:
    """Of all items together; only shingles that several items have come to the driver."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in _items(batch.column("item_id").to_pylist(), batch.column("text")):
                own = np.unique(_hashes(item.words)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([None, *own.tolist()], pa.int64())], ["shingle"])  # null counts the items

    seen = rows.mapInArrow(shingles, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1 or shingle is null").toArrow()
    counts = dict(zip(seen.column("shingle").to_pylist(), seen.column("n").to_pylist(), strict=True))
    n_items = counts.pop(None, 0)
    return Weights.of(n_items, np.array(list(counts), np.int64).view(np.uint64), np.array(list(counts.values()), np.int64))


def _hits(searcher: Searcher, batch: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
    """For each document of a batch, in its order: what was found in it."""
    text = _lower(batch.column("text"))
    for lo, hi in text_batches(text):
        words, at = word_hashes(*utf8(text.slice(lo, hi - lo)))
        place, start, item = searcher.candidates(words)
        doc = np.searchsorted(at, place, "right") - 1
        order = np.argsort(doc, kind="stable")
        start, item = start[order], item[order]
        found: dict[int, dict] = {}
        docs, first = np.unique(doc[order], return_index=True)
        for d, a, b in zip(docs.tolist(), first.tolist(), np.append(first, len(doc))[1:].tolist(), strict=True):
            if best := searcher._best(words[at[d] : at[d + 1]], start[a:b] - at[d], item[a:b]):
                found[d] = best
        if searcher.brief:
            for d, some in enumerate(searcher.whole(words, at)):
                if some:
                    found.setdefault(d, {}).update({i: (1.0, first, n) for i, first, n in some})
        for d in sorted(found):
            yield lo + d, found[d]


def find_items(docs: DataFrame, items: DataFrame, least: float = 0.8, lot: int = 4096) -> DataFrame:
    """Passages of ``items`` (item_id, text) in documents (doc_id, text), from their whole texts.

    One row for each document and item that it holds with a similarity of at least ``least``: the
    weighted Jaccard of the item's five-word shingles and those of a window as long as the item,
    or shorter where the document begins or ends in it; the best of all windows is given, and
    ``n_windows`` counts those of at least ``least``; a shingle's weight is the logarithm of how
    rare it is among the items. Words are runs without white space, in lower case. An item of
    fewer than five words is one shingle, its whole sequence, and is found where those words stand
    next to each other, with similarity 1; one without words, or with a null text, is found nowhere.

    Items go to the shared folder in files of at most ``lot``, from which tasks read them, one file
    at a time; weights are of all items, so lots don't change what is found. Documents are read
    once and aren't shuffled. Null texts of documents are empty; repeated documents give repeated
    rows, a null doc_id stays null; equal rows of ``items`` count once.
    """
    lots, names = _lots(items, least, lot), [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in lots.search(batches):
            out = [(doc, key, *what) for doc, some in enumerate(found) for key in sorted(some, key=lambda x: (x is not None, x)) for what in some[key]]
            if out:
                doc, *rest = zip(*out, strict=True)
                kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def drop_found(docs: DataFrame, items: DataFrame, least: float = 0.8, lot: int = 4096) -> DataFrame:
    """``docs``, all columns, without the documents in which :func:`find_items` finds an item; nothing is shuffled."""
    lots = _lots(items, least, lot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in lots.search(batches):
            yield batch.filter(pa.array([not some for some in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
