"""Similarity join of documents by the Jaccard index of their word n-grams, exactly.

The overlap of two sets is an entry of the product of the document by n-gram incidence matrix with
its transpose. The product is made in blocks, and only where size-derived bounds leave a chance:

* A set of n n-grams can only be linked with sets that hold ceil(t * n) of its n-grams, so two
  linked sets share one of the first n - ceil(t * n) + 1 in any common order (the prefix). The
  order used puts the quarter of all hashes below ``REGION`` first, the rarest first, then the
  others, and n-grams of very frequent hash buckets last. How rare an n-gram is comes from counts
  with partial results, and n-grams meet their counts in a join that can split a very frequent one.
* A quarter of a small set is too little to choose from: phrases that unlike documents share by
  chance, the more the larger the corpus, would stand in its prefix. So sets of up to ``_SMALL``
  n-grams have an order of their own, the rarest of all their n-grams first. Sets that may be
  linked with sets on either side of that size take part in both orders.
* The smaller of two linked sets shares one of its first n - ceil(2t / (1 + t) * n) + 1, its
  short prefix, with the prefix of the larger.
* n-grams of a prefix that only one set holds link nothing. Sets whose prefix consists of such
  ones, as that of nearly every document without a near copy, go no further.
* The others form families: sets connected by n-grams of a prefix and a short prefix, of sizes
  that can be linked. Every link lies within a family.
* Within a family only sets of the same or the next size class can be linked (a class spans a
  factor 1 / t). Each pair of blocks of such classes is one product: overlap counts are
  accumulated n-gram by n-gram, and pairs below the bound are discarded.
* A set is copied to each product of its block. A class has up to 16 blocks of 4,000 sets; if it is
  larger its blocks grow, and become more only where they would have more than 4,000,000 n-grams
  (32 MB), so copies grow with the bytes of the family over 32 MB. A task goes through its product
  in tiles of 400 by 400 sets and keeps of the links a forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import mix, shingle_hashes, text_batches, utf8, word_hashes
from tidelog.llm.components import components
from tidelog.stage import Stage

SETS = "doc_id long, n long, sig long, block int, counts binary"
POSTINGS = "h long, sig long, n long, r0 long, kind int"
MEMBERS = "v long, family long, copies long, n long, grams binary"
REGION = 1 << 62  # a quarter of the unsigned 64-bit hashes
_SMALL = 100  # up to so many n-grams a set is ordered by the counts of all of them
_FIRST, _LATER, _OF_SMALL = 0, 1, 2  # kinds of postings: of the first region, what follows it, and of small sets
_BUCKETS, _PER = 1 << 18, 1 << 12
_BLOCK, _TILES, _BLOCKS = 400, 10, 16  # sets of a tile, tiles of a block while a size class has no more than so many blocks
_BLOCK_GRAMS, _TILE_GRAMS = 4_000_000, 1_000_000


def grams(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-gram hashes of each text, sorted within it, and the n + 1 offsets.

    A text of fewer than k words has its whole sequence as its one n-gram, and one without words none.
    """
    size = np.diff(at)
    per = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    doc = np.repeat(np.arange(len(size)), per)
    place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(at[:-1], per)
    full = shingle_hashes(words, k)
    h = np.empty(len(place), np.uint64)
    long = (size >= k)[doc]
    h[long] = full[place[long]]
    for i in np.flatnonzero((size > 0) & (size < k)):
        h[np.searchsorted(doc, i)] = mix(shingle_hashes(words[at[i] : at[i + 1]], int(size[i])) + np.uint64(size[i]))[0]
    order = np.lexsort((h, doc))
    h = h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.searchsorted(doc[keep], np.arange(len(size) + 1))


def _signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set, the same for the same set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))


def _each(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple]:
    for batch in batches:
        for lo, hi in text_batches(batch.column("text")):
            part = batch.slice(lo, hi - lo)
            words, at = word_hashes(*utf8(part.column("text")), lower=True)
            h, offsets = grams(words, at, k)
            yield part, h, offsets


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(46)).astype(np.int64)  # 18 bits


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Size and signature of each document's set; and, in blocks, how often each hash bucket occurs in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SETS.split(", ")]
        counts = np.zeros(_BUCKETS, np.int64)
        for part, h, at in _each(batches, k):
            counts += np.bincount(_bucket(h), minlength=_BUCKETS)
            n = len(part)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(_signatures(h, at).view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        blocks = [b for b in range(_BUCKETS // _PER) if counts[b * _PER : (b + 1) * _PER].any()]
        if blocks:
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(blocks, pa.int32()), pa.array([counts[b * _PER : (b + 1) * _PER].astype("<i4").tobytes() for b in blocks], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def _frequent(sets: DataFrame) -> bytes:
    """A bit for each hash bucket: whether it is far above the mean. Its size is fixed, 32 KB, whatever the input."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_PER, np.int64)
        for c in table.column("counts").to_pylist():
            total += np.frombuffer(c, "<i4")
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    total = np.zeros(_BUCKETS, np.int64)
    for r in sets.filter("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        total[r.block * _PER : (r.block + 1) * _PER] = np.frombuffer(r.counts, np.int64)
    return np.packbits(total > max(64, 8 * total.mean())).tobytes()


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _postings(docs: DataFrame, k: int, percent: int, frequent: bytes) -> DataFrame:
    """n-grams that may be in a prefix: those of the first region, or, where they are too few, what follows in the order.

    Of small sets all n-grams, under hashes of their own: they have an order of their own. A set that may be linked with
    small and with larger ones has both. A set that occurs again in a task is left out: a group of copies is one set for
    each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in POSTINGS.split(", ")]
        hot = np.unpackbits(np.frombuffer(frequent, np.uint8)).astype(bool)
        done: set[int] = set()
        for _, h, at in _each(batches, k):
            sig, n = _signatures(h, at), np.diff(at)
            new = np.zeros(len(n), bool)
            for i, s in enumerate(sig.tolist()):
                if n[i] and s not in done:
                    done.add(s)
                    new[i] = True
            doc = np.repeat(np.arange(len(n)), n)
            kind = np.where(hot[_bucket(h)], 2, (h >= np.uint64(REGION)).astype(int))
            r0 = np.bincount(doc[kind == 0], minlength=len(n))
            lack = np.maximum(0, prefix_size(n, percent) - r0)
            # the place of each n-gram among those of its document that aren't in the first region
            order = np.lexsort((h, kind, doc))
            behind = kind[order] > 0
            ahead = np.concatenate([[0], np.cumsum(behind)])
            place = ahead[:-1] - ahead[at[:-1]][doc[order]]
            take = np.zeros(len(h), bool)
            take[order] = ~behind | (place < lack[doc[order]])
            take &= (new & (100 * n >= percent * (_SMALL + 1)))[doc]
            small = (new & (n <= _SMALL))[doc]
            d = np.concatenate([doc[take], doc[small]])
            key = np.concatenate([h[take], mix(h[small] ^ np.uint64(0x9E6C63D0876A9A47))])
            which = np.concatenate([np.where(kind[take] > 0, _LATER, _FIRST), np.full(small.sum(), _OF_SMALL)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(sig[d].view(np.int64)), pa.array(n[d]), pa.array(np.where(which == _OF_SMALL, n[d], r0[d])), pa.array(which)], names)

    return docs.select("text").mapInArrow(run, POSTINGS)


def _in_prefix(postings: DataFrame, percent: int, stage: Stage) -> DataFrame:
    """Prefix n-grams that at least two tasks or sets gave; ``first`` are those of the short prefix.

    An n-gram's place in the order goes by its number of postings, one for each task and set: any
    number does that is the same for all sets that hold it.
    """
    counts = postings.groupBy("h").agg(F.count("*").alias("df")).filter("df >= 2")
    # written, so that the join may split a very frequent n-gram and nothing relies on how it was dealt
    counted = stage.save(postings.join(counts.hint("merge"), "h").select("h", "sig", "n", "r0", "kind", "df"), "counted")
    stage.drop("postings")
    once = counted.dropDuplicates(["sig", "h"])
    of = Window.partitionBy("sig", F.col("kind") == _OF_SMALL)
    n, r0, later = F.col("n"), F.col("r0"), F.col("kind") == _LATER
    shared = F.count_if(~later).over(of)
    prefix = n - F.floor((percent * n + 99) / 100) + 1
    short = n - F.floor((2 * percent * n + 99 + percent) / (100 + percent)) + 1
    # n-grams with one posting are the rarest and come first
    place = F.row_number().over(of.orderBy(later, "df", "h")) + (r0 - shared)
    placed = once.withColumn("place", place)
    return placed.filter(later | (F.col("place") <= prefix)).select("h", "sig", "n", F.when(later, short > r0).otherwise(F.col("place") <= short).alias("first"))


def _stars(prefix: DataFrame, percent: int) -> DataFrame:
    """Edges that connect what may be linked.

    Each list of sets with a common prefix n-gram is a star for each size class: around the least signature of those that
    have the n-gram in their short prefix stand all sets of that class and the next.
    """
    sized = prefix.withColumn("size", _size_class(F.col("n"), percent))
    hubs = sized.filter("first").groupBy("h", "size").agg(F.min("sig").alias("hub"))
    hubs = hubs.withColumn("size", F.explode(F.array("size", F.col("size") + 1)))
    return sized.join(hubs, ["h", "size"]).select(F.col("sig").alias("a"), F.col("hub").alias("b")).filter("a <> b").distinct()


def _size_class(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("int")


def _columns(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a block of the incidence matrix, by n-gram: n-grams and the rows that have them."""
    h, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(h, kind="stable")
    return h[order], row[order]


def overlaps(a: tuple[np.ndarray, np.ndarray], n_a: int, b: tuple[np.ndarray, np.ndarray], n_b: int) -> np.ndarray:
    """Numbers of common n-grams of each of the ``n_a`` rows of ``a`` with each of the ``n_b`` of ``b``: one block of the product."""
    h, row = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1] + n_a])
    order = np.argsort(h, kind="stable")  # merges two sorted runs
    h, row = h[order], row[order]
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    of_a = np.add.reduceat((row < n_a).astype(np.int64), cut)
    of_b = np.diff(np.append(cut, len(h))) - of_a
    out = np.zeros(n_a * n_b, np.int64)
    thick = of_a * of_b > 4096
    # columns of many documents: dense; a lot of them at a time
    columns = np.flatnonzero(thick)
    dense = np.zeros((n_a, n_b), np.float32)
    for at in range(0, len(columns), 1024):
        part = columns[at : at + 1024]
        size = of_a[part] + of_b[part]
        column = np.repeat(np.arange(len(part)), size)
        rows = row[np.repeat(cut[part], size) + np.arange(len(column)) - np.repeat(np.cumsum(size) - size, size)]
        both = np.zeros((n_a + n_b, len(part)), np.float32)
        both[rows, column] = 1
        dense += both[:n_a] @ both[n_a:].T
    # the others: each pair of entries of a column is one count
    columns = np.flatnonzero(~thick & (of_a > 0) & (of_b > 0))
    pairs = of_a[columns] * of_b[columns]
    ends = np.cumsum(pairs)
    at = 0
    while at < len(columns):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), "right")))
        c, p = columns[at:to], pairs[at:to]
        col = np.repeat(c, p)
        k = np.arange(len(col)) - np.repeat(np.cumsum(p) - p, p)
        i, j = k // of_b[col], k % of_b[col]
        out += np.bincount(row[cut[col] + i] * n_b + row[cut[col] + of_a[col] + j] - n_a, minlength=len(out))
        at = to
    return out.reshape(n_a, n_b) + dense.astype(np.int64)


def _tiles(rows: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Rows in lots of at most 400 that have a bounded number of n-grams together, one row at least."""
    ends, out, at = np.cumsum(size[rows]), [], 0
    while at < len(rows):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TILE_GRAMS, "right"))
        to = min(max(to, at + 1), at + _BLOCK)
        out.append(rows[at:to])
        at = to
    return out


def _connect(label: np.ndarray, i: np.ndarray, j: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links between rows ``i`` and ``j`` that connect what wasn't connected yet; ``label`` is brought up to date.

    Each pass takes one such link of each row, so that the passes are few and links within what is
    connected, which may be all pairs, are never listed.
    """
    out = []
    while True:
        new = linked & (label[i][:, None] != label[j][None, :])
        rows = np.flatnonzero(new.any(1))
        if not len(rows):
            return out
        for x, y in zip(i[rows].tolist(), j[new[rows].argmax(1)].tolist(), strict=True):
            low, high = sorted((int(label[x]), int(label[y])))
            if low != high:
                label[label == high] = low
                out.append((x, y))


def _product(percent: int):
    """Links between the sets of two blocks, or of one: a forest that connects them, and how many each set has."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        v, n, copies = (table.column(c).to_numpy() for c in ("v", "n", "copies"))
        grams = table.column("grams").chunk(0) if len(table) else pa.array([], pa.binary())
        same = bool((side == 0).all())

        def cut(rows: np.ndarray) -> list[tuple]:
            return [(t, _columns([np.frombuffer(x, "<u8") for x in grams.take(pa.array(t)).to_pylist()])) for t in _tiles(rows, n)]

        left = cut(np.flatnonzero(side == 0))
        right = left if same else cut(np.flatnonzero(side == 1))
        edges, links, label = [], np.zeros(len(v), np.int64), np.arange(len(v))
        for p, (i, a) in enumerate(left):
            for q, (j, b) in enumerate(right):
                if same and q < p:
                    continue
                common = overlaps(a, len(i), b, len(j))
                linked = 100 * common >= percent * (n[i][:, None] + n[j][None, :] - common)
                linked &= v[i][:, None] != v[j][None, :]
                links[i] += linked @ copies[j]
                if not (same and p == q):
                    links[j] += copies[i] @ linked
                edges += _connect(label, i, j, linked)
        some = np.flatnonzero(links)
        x, y = np.array(edges, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.concatenate([v[x], v[some]]), "b": pa.array([*v[y].tolist(), *([None] * len(some))], pa.int64()), "links": np.concatenate([np.zeros(len(x), np.int64), links[some]])})

    return run


def _dealt(full: DataFrame) -> DataFrame:
    """A row for each set and product that it takes part in."""
    blocks = full.groupBy("family", "size").agg(F.greatest(F.least(F.ceil(F.count("*") / (_BLOCK * _TILES)), F.lit(_BLOCKS)), F.ceil(F.sum("n") / _BLOCK_GRAMS)).cast("int").alias("blocks"))
    dealt = full.join(blocks, ["family", "size"]).join(blocks.select("family", (F.col("size") - 1).alias("size"), F.col("blocks").alias("above")), ["family", "size"], "left").join(blocks.select("family", (F.col("size") + 1).alias("size"), F.col("blocks").alias("below")), ["family", "size"], "left")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks").cast("long")).cast("int"))
    # the products a set takes part in: with the blocks of its own class, of the next, and of the one before
    struct = lambda size, i, upper, j, side: F.struct(size.alias("size1"), i.alias("i"), upper.alias("size2"), j.alias("j"), side.alias("side"))
    zero, one, own, size = F.lit(0), F.lit(1), F.col("own"), F.col("size")
    span = lambda n: F.when(F.coalesce(n, zero) > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<int>"))
    within = F.transform(span(F.col("blocks")), lambda j: struct(size, F.least(own, j), size, F.greatest(own, j), F.when(own <= j, zero).otherwise(one)))
    up = F.transform(span(F.col("above")), lambda j: struct(size, own, size + 1, j, zero))
    down = F.transform(span(F.col("below")), lambda j: struct(size - 1, j, size, own, one))
    return dealt.withColumn("t", F.explode(F.concat(within, up, down))).select("family", "t.*", "v", "n", "copies", "grams")


def join(docs: DataFrame, stage: Stage, k: int = 4, percent: int = 85) -> DataFrame:
    """Component of each document (doc_id, text) under links of similarity ``percent`` / 100 or more.

    One row a document: doc_id, n_shingles, component_id (the least doc_id it reaches, itself
    included), n_links (documents it is linked with). Sets are of ``k`` consecutive words in lower
    case (A-Z only); a text of fewer words is one n-gram; an empty or null text has none and is
    linked with nothing. Documents with equal sets are one vertex. Rows of one doc_id are one
    document; a null doc_id belongs to a component by its copies only. n-grams are compared by
    64-bit hashes.
    """
    sets = stage.save(_sets(docs, k), "sets")
    frequent = _frequent(sets)
    sets = sets.filter("block is null").select("doc_id", "n", "sig")
    postings = stage.save(_postings(docs, k, percent, frequent), "postings")
    prefix = stage.save(_in_prefix(postings, percent, stage), "prefix")
    stage.drop("counted")
    families = components(_stars(prefix, percent), stage, "families")
    classes = sets.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("v"), F.count("*").alias("copies"), F.first("n").alias("n"))
    members = classes.join(families.select(F.col("v").alias("sig"), F.col("component").alias("family")), "sig").filter("v is not null")
    members = stage.save(members.select("v", "sig", "family", "copies", "n"), "members")
    stage.drop("prefix")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, at in _each(batches, k):
            own = _signatures(h, at).view(np.int64) == part.column("sig").to_numpy()
            data = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            out = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("v", "family", "copies", "n")), pa.array(data, pa.binary())], [x.split()[0] for x in MEMBERS.split(", ")])
            yield out.filter(pa.array(own))

    # members grow with the documents: the same plan at every size, not a broadcast while they are few
    texts = docs.select("doc_id", "text").join(members.withColumn("doc_id", F.col("v")).hint("merge"), "doc_id").select("text", "sig", "v", "family", "copies", "n")
    full = stage.save(texts.mapInArrow(to_sets, MEMBERS).withColumn("size", _size_class(F.col("n"), percent)), "full")
    out = _dealt(full).groupBy("family", "size1", "i", "size2", "j").applyInArrow(_product(percent), "a long, b long, links long")
    out = stage.save(out, "links")
    stage.drop("full")
    linked = components(out.filter("b is not null").select("a", "b"), stage, "linked")
    counts = out.filter("b is null").groupBy(F.col("a").alias("v")).agg(F.sum("links").alias("links"))
    best = classes.join(linked, "v", "left").join(counts, "v", "left").select("sig", F.coalesce("component", "v").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    best = stage.save(best, "classes")
    result = sets.join(best, "sig", "left")
    alone = F.col("n") == 0
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"))
