"""Removal of word sequences that an earlier document already has, by FM-indexes over shards.

Every window of 13 words has an anchor that depends on its words alone: the least hash of the
four-word sequences in it. Runs of windows with one anchor form a segment. Windows that are equal
have equal anchors, so a shard that owns an anchor sees every occurrence of its windows, and the
work grows with the text, not with its square.

1. Segments' anchors are counted, with partial counts, and only those that two documents share
   are kept, by a join that can split an anchor of very many documents. Anchors of more than
   10,000 windows are marked.
2. Segments with such anchors are cut out; equal segments are merged before they are shuffled,
   which leaves of a passage in a third of all documents one row for each task. Segments of marked
   anchors are cut into their windows, which belong to the shard of their own words: windows that
   straddle the edge of such a passage are all different but have few anchors.
3. Each shard builds an FM-index of its distinct segments: a BWT in a wavelet matrix over packed
   bits and, instead of the suffix array, the rank of each suffix's document. Segments stream past
   it: backward search gives the matching statistic of each word, the length of the longest run of
   words that ends there and that another place of the shard, or an earlier document with the same
   segment, has too. Those of at least 13 words are reported with the least doc_id of their interval.
4. What was found goes back to the rows of documents by segment; a row is its doc_id and a hash of
   its text, so rows of one doc_id with different texts are kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import _MULT, mix, shingle_hashes, text_batches, utf8, word_hashes
from tidelog.stage import Stage

GRAM, _MOST = 4, 15
ANCHORS = "doc_id long, anchor long, place long"
SEGMENTS = "doc_id long, row long, segments array<struct<seg:long,start:int>>, n long, home long, seg long, low long, high long, codes binary"
FOUND = "seg long, first array<long>"
_SHARD_WINDOWS, _HOT_WINDOWS, _FLUSH = 40_000, 10_000, 200_000


# --------------------------------------------------------------------------- FM-index


class WaveletMatrix:
    """Rank of symbols in a sequence, from one packed bit array for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.words, self.counts, self.zeros = levels, [], [], []
        s = symbols
        for level in range(levels - 1, -1, -1):
            bit = ((s >> level) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32))
            ones = bit.astype(bool)
            self.zeros.append(int(len(s) - ones.sum()))
            s = np.concatenate([s[~ones], s[ones]])
        # where each symbol's run begins at the last level
        self.start = self._down(np.arange(1 << levels), np.zeros(1 << levels, np.int64))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of each symbol lie before each position."""
        return self._down(symbol, at) - self.start[symbol]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            one = ((symbol >> (self.levels - 1 - i)) & 1).astype(bool)
            ones = self._ones(i, at)
            at = np.where(one, self.zeros[i] + ones, at - ones)
        return at

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)


class FmIndex:
    """Compressed index of sequences for patterns of at most ``depth`` symbols.

    Suffixes are sorted by their first ``depth`` symbols, by doubling, which is all that backward
    search for such patterns needs. Their order isn't kept, only the BWT and, for each suffix, the
    rank of its ``owner`` (32 bits), which is what is asked of an interval.
    """

    def __init__(self, text: np.ndarray, depth: int, owner: np.ndarray | None = None):
        n, rank, have = len(text), text.astype(np.int64), 1
        while have < depth:
            step = min(have, depth - have)
            tail = np.zeros(n, np.int64)
            tail[: n - step] = rank[step:] + 1
            pair = rank * (int(tail.max()) + 1) + tail
            rank, have = np.unique(pair, return_inverse=True)[1].astype(np.int64), have + step
        suffixes = np.argsort(rank, kind="stable")
        self.length, self.size = n, int(text.max()) + 1
        self.bwt = WaveletMatrix(text[suffixes - 1], max(1, (self.size - 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))])
        if owner is not None:
            self.owners, ranks = np.unique(owner, return_inverse=True)
            self.rank = np.append(ranks.astype(np.int32)[suffixes], np.int32(len(self.owners)))

    def statistics(self, stream: np.ndarray, ends: np.ndarray, most: int, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a stream at the positions ``ends``, by backward search.

        For each position: how many symbols up to and with it (at most ``most``) occur together in
        at least ``need`` places of the index, and the interval of those.
        """
        matched, lo, hi, live = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), self.length, np.int64), np.arange(len(ends))
        for j in range(most):
            c = stream[ends[live] - j]
            a, b = self.first[c] + self.bwt.rank(c, lo[live]), self.first[c] + self.bwt.rank(c, hi[live])
            go = b - a >= need[live]
            live = live[go]
            if not len(live):
                break
            lo[live], hi[live], matched[live] = a[go], b[go], j + 1
        return matched, lo, hi

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least owner within each interval; intervals are equal or apart, as those of equally long patterns are."""
        starts, back = np.unique(lo, return_inverse=True)
        stops = np.zeros(len(starts), np.int64)
        stops[back] = hi
        return self.owners[np.minimum.reduceat(self.rank, np.stack([starts, stops], 1).reshape(-1))[::2][back]]


def _shard(table: pa.Table, window: int) -> pa.Table:
    """Least doc_id of each window of the shard's segments, for segments that have something to remove."""
    table = table.combine_chunks()
    # the same segment comes from several tasks
    seg, at, of = np.unique(table.column("seg").to_numpy(), return_index=True, return_inverse=True)
    low, high = np.full(len(seg), np.iinfo(np.int64).max), np.full(len(seg), np.iinfo(np.int64).min)
    np.minimum.at(low, of, table.column("low").to_numpy())
    np.maximum.at(high, of, table.column("high").to_numpy())
    column = table.column("codes").chunk(0).take(pa.array(at))
    size = pa.compute.binary_length(column).to_numpy() // 4
    codes = np.frombuffer(b"".join(column.to_pylist()), "<u4")
    n = len(seg)
    ends = np.cumsum(size + 1)
    text = np.zeros(int(ends[-1]), np.int64)  # 0 behind each segment
    solid = np.ones(len(text), bool)
    solid[ends - 1] = False
    text[solid] = np.unique(codes, return_inverse=True)[1] + 1
    owner = np.repeat(np.arange(n), size + 1)
    index = FmIndex(text, window, low[owner])
    need = np.where(low < high, 1, 2)[owner]  # a segment that one document has is found at its own place
    begin = ends - size - 1
    per = size - window + 1
    # only words with a whole window behind them can reach the threshold
    last = np.repeat(begin, per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + window - 1
    least = np.full(len(last), np.iinfo(np.int64).max)
    for i in range(0, len(last), 1 << 16):
        part = last[i : i + (1 << 16)]
        matched, lo, hi = index.statistics(text, part, window, need[part])
        above = np.flatnonzero(matched >= window)
        if len(above):
            least[i + above] = index.least_owner(lo[above], hi[above])
    offsets = np.concatenate([[0], np.cumsum(per)])
    some = np.minimum.reduceat(least, offsets[:-1]) < high
    keep = np.flatnonzero(some)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(least)).take(pa.array(keep))
    return pa.table({"seg": seg[keep], "first": lists})


# --------------------------------------------------------------------------- segments


def _anchors(words: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of the window that starts at each word, and whether a window of one document does."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    least, have, want = shingle_hashes(words, GRAM), 1, window - GRAM + 1
    while have < want:
        step = min(have, want - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    inside = np.ones(n, bool)
    for k in range(1, window):  # a document that begins within the window
        cut = at[1:-1] - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return least[:n], inside


def _runs(anchor: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and numbers of windows of segments: consecutive windows with one anchor, at most 15."""
    if not len(anchor):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    starts = np.flatnonzero(new)
    n = np.diff(np.append(starts, len(anchor)))
    parts = -(-n // _MOST)
    first = np.repeat(starts, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * _MOST
    stop = np.append(first[1:], len(anchor))
    n = np.minimum(stop - first, _MOST)
    ok = inside[first]
    return first[ok], n[ok]


def _single(doc: np.ndarray, starts: np.ndarray, n: np.ndarray, anchor: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments, those that are ``hot`` as one segment for each of their windows."""
    parts = np.where(hot, n, 1)
    of = np.repeat(np.arange(len(n)), parts)
    starts = starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    hot = hot[of]
    return doc[of], starts, np.where(hot, 1, n[of]), anchor[of], hot


def _keys(words: np.ndarray, starts: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Hash of each segment's words."""
    size = n + window - 1
    out = size.astype(np.uint64)
    for i in range(int(size.max(initial=0))):
        in_it = size > i
        out[in_it] += words[starts[in_it] + i] * _MULT[i]
    return mix(out)


def repeats(docs: DataFrame, stage: Stage, window: int = 13) -> DataFrame:
    """Segments of documents with windows that start in a document of a smaller doc_id too.

    Rows (doc_id, row, start, first): the words from ``start`` on begin windows whose least doc_ids
    are ``first``; ``row`` is xxhash64 of the text. Words are compared by 32 bits of their hashes, so two different words in otherwise
    equal windows are taken for one another once in 4 * 10**9 such pairs.
    """
    rows = docs.select("doc_id", "text").filter("doc_id is not null and text is not null").withColumn("row", F.xxhash64("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_batches(batch.column("text")):
                words, at = word_hashes(*utf8(batch.column("text").slice(lo, hi - lo)))
                anchor, inside = _anchors(words, at, window)
                starts, n = _runs(anchor, inside)
                if len(starts):
                    doc = np.searchsorted(at, starts, "right") - 1
                    keys = batch.column("doc_id").slice(lo, hi - lo).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(keys[doc]), pa.array(anchor[starts].view(np.int64)), pa.array((starts - at[doc]) * 32 + n)], ["doc_id", "anchor", "place"])

    found = stage.save(rows.select("doc_id", "text").mapInArrow(anchors, ANCHORS), "anchors")
    counts = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum(F.col("place") % 32).alias("n"))
    several = counts.filter("low < high").select("anchor", F.when(F.col("n") > _HOT_WINDOWS, 16).otherwise(0).alias("hot"))
    shared = stage.save(found.join(several, "anchor").select("doc_id", "anchor", (F.col("place") + F.col("hot")).alias("place")), "shared-anchors")
    stage.drop("anchors")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SEGMENTS.replace("struct<seg:long,start:int>", "struct").split(", ")]
        kind = pa.struct([("seg", pa.int64()), ("start", pa.int32())])
        kept: dict[int, list] = {}  # distinct segments of this task: what deals them, low, high, codes

        def flush() -> pa.RecordBatch:
            n = len(kept)
            home, low, high, codes = zip(*kept.values(), strict=True)
            out = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(kind)), pa.nulls(n, pa.int64()), pa.array(home, pa.int64()), pa.array(list(kept), pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(codes, pa.binary())]
            kept.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            for lo, hi in text_batches(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                words, at = word_hashes(*utf8(part.column("text")))
                codes = words.astype("<u4")  # the low halves
                where = part.column("places")
                size = pa.compute.list_value_length(where).to_numpy(zero_copy_only=False)
                flat = where.flatten()
                place = flat.field("place").to_numpy()
                anchor = flat.field("anchor").to_numpy().view(np.uint64)
                doc = np.repeat(np.arange(hi - lo), size)
                own, inside = _anchors(words, at, window)
                starts, n, hot = at[doc] + place // 32, place % 16, place % 32 >= 16
                # a place of another row with the same doc_id isn't one of this text
                ok = starts + n + window - 1 <= at[doc + 1]
                ok[ok] &= own[starts[ok]] == anchor[ok]
                doc, starts, n, anchor, hot = doc[ok], starts[ok], n[ok], anchor[ok], hot[ok]
                _, once = np.unique(starts, return_index=True)
                doc, starts, n, anchor, hot = doc[once], starts[once], n[once], anchor[once], hot[once]
                if not len(starts):
                    continue
                if hot.any():
                    doc, starts, n, anchor, hot = _single(doc, starts, n, anchor, hot)
                    ok = own[starts] == anchor
                    doc, starts, n, anchor, hot = doc[ok], starts[ok], n[ok], anchor[ok], hot[ok]
                seg = _keys(words, starts, n, window).view(np.int64)
                home = np.where(hot, seg, anchor.view(np.int64))
                keys = part.column("doc_id").to_numpy()
                key = keys[doc]
                distinct, first, of = np.unique(seg, return_index=True, return_inverse=True)
                low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
                np.minimum.at(low, of, key)
                np.maximum.at(high, of, key)
                for g, i, a, b in zip(distinct.tolist(), first.tolist(), low.tolist(), high.tolist(), strict=True):
                    if (old := kept.get(g)) is None:
                        kept[g] = [int(home[i]), a, b, codes[starts[i] : starts[i] + n[i] + window - 1].tobytes()]
                    else:
                        old[1], old[2] = min(old[1], a), max(old[2], b)
                values = pa.StructArray.from_arrays([pa.array(seg), pa.array((starts - at[doc]).astype(np.int32))], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)), values)
                windows = np.bincount(doc, n, hi - lo).astype(np.int64)
                none = [pa.nulls(hi - lo, pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), lists, pa.array(windows), *none, pa.nulls(hi - lo, pa.binary())], names).filter(pa.array(windows > 0))
                if len(kept) >= _FLUSH:
                    yield flush()
        if kept:
            yield flush()

    places = shared.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place")).alias("places"))
    cut = stage.save(rows.join(places.hint("merge"), "doc_id").select("doc_id", "text", "row", "places").mapInArrow(segments, SEGMENTS), "segments")
    stage.drop("shared-anchors")

    windows = cut.agg(F.sum("n")).first()[0] or 0
    shard = F.pmod(F.xxhash64("home"), F.lit(max(1, windows // _SHARD_WINDOWS))).alias("shard")
    distinct = cut.filter("seg is not null").select(shard, "seg", "low", "high", "codes")
    first = stage.save(distinct.groupBy("shard").applyInArrow(lambda table: _shard(table, window), FOUND), "first")
    each = cut.filter("segments is not null").select("doc_id", "row", F.explode("segments").alias("s")).select("doc_id", "row", "s.*")
    hits = each.join(first, "seg").filter(F.exists("first", lambda x: x < F.col("doc_id")))
    return hits.select("doc_id", "row", "start", "first")


def remove_repeats(docs: DataFrame, stage: Stage, window: int = 13) -> DataFrame:
    """Each document (doc_id, text) without the words of windows that a smaller doc_id has too.

    Adds n_words, n_removed and replaces ``text`` by what is kept, with its white space; a removed
    word takes the white space behind it along. Other columns stay. Windows are judged on the
    input. Null texts stay null and have no words; texts of fewer than ``window`` words stay; rows
    of equal doc_id, a handful at most, don't remove anything from each other, whether their texts
    are equal or not; rows with a null doc_id are left as they are and remove nothing.
    """
    found = repeats(docs, stage, window).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "first")).alias("found"))
    found = stage.save(found.select(F.col("doc_id").alias("__found_doc_id"), F.col("row").alias("__found_row"), F.col("found").alias("__found")), "found")
    stage.drop("segments")
    stage.drop("first")
    others = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    same = (docs["doc_id"] == F.col("__found_doc_id")) & (F.xxhash64(docs["text"]) == F.col("__found_row"))
    joined = docs.join(found.hint("merge"), same, "left").select(*(docs[c] for c in others), docs["text"], "__found")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*others).schema) + ", text string, n_words long, n_removed long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_batches(batch.column("text"), 1 << 24):
                part = batch.slice(lo, hi - lo)
                texts, keys, found = part.column("text").to_pylist(), part.column("doc_id").to_pylist(), part.column("__found")
                size = pa.compute.fill_null(pa.compute.list_value_length(found), 0).to_pylist()
                n_words, n_removed = [], []
                for i, text in enumerate(texts):
                    if not size[i]:
                        n_words.append(_count(text))
                        n_removed.append(0)
                        continue
                    hits = found[i].values
                    starts = hits.field("start").to_numpy()
                    lists = hits.field("first")
                    per = pa.compute.list_value_length(lists).to_numpy()
                    least = lists.flatten().to_numpy()
                    at = np.repeat(starts, per) + np.arange(len(least)) - np.repeat(np.cumsum(per) - per, per)
                    texts[i], n, gone = _without(text, at[least < keys[i]], window)
                    n_words.append(n)
                    n_removed.append(gone)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*others, "text", "n_words", "n_removed"])

    return joined.mapInArrow(cut, schema)


def _count(text: str | None) -> int:
    return len((text or "").encode().split())


def _without(text: str, windows: np.ndarray, window: int) -> tuple[str, int, int]:
    """The text without the words of the windows that start at the given words; its words; those removed."""
    data = text.encode()
    buf = np.frombuffer(data, np.uint8)
    solid = np.concatenate([[False], ~((buf == 32) | ((buf >= 9) & (buf <= 13))), [False]])
    starts = np.flatnonzero(solid[1:-1] & ~solid[:-2])
    marks = np.zeros(len(starts) + window + 1, np.int64)
    np.add.at(marks, windows, 1)
    np.add.at(marks, windows + window, -1)
    gone = np.cumsum(marks)[: len(starts)] > 0
    stops = np.append(starts[1:], len(buf))
    change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    out, at = [], 0
    for a, b in change.reshape(-1, 2).tolist():
        out.append(data[at : starts[a]])
        at = int(stops[b - 1])
    out.append(data[at:])
    return b"".join(out).decode(), len(starts), int(gone.sum())
