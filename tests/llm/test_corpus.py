"""Operators on whole corpora against brute force: joins, repeats, search, decontamination, the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelog.llm import decontam, ngram_join, substring
from tidelog.llm import queries as Q
from tidelog.llm.common import word_hashes
from tidelog.llm.components import components
from tidelog.llm.topk import top_k
from tidelog.stage import Stage


def corpus(seed=1, n=120):
    """Texts with exact copies, edited copies, shared passages, short and odd ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "é", "ß"]
    text = lambda k: " ".join(rng.choices(words, k=k))
    shared = [text(20), text(60)]
    rows: list[tuple] = [(0, None), (1, ""), (2, " \n\t"), (3, "a b"), (4, "A  b\n"), (5, "a b c d"), (5, "a b c d")]
    for i in range(10, n):
        kind, old = rng.random(), [t for _, t in rows[7:] if t]
        if kind < 0.15 and old:
            rows.append((i, rng.choice(old)))
        elif kind < 0.45 and old:
            w = rng.choice(old).split()
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((i, "  ".join(w)))
        elif kind < 0.65:
            rows.append((i, f"{text(rng.randint(1, 30))}\n{rng.choice(shared)} {text(rng.randint(0, 30))}"))
        else:
            rows.append((i, text(rng.randint(1, 200))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0, 0) for i, t in rows], "doc_id long, text string, found string, n_words int, h int").repartition(3)


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    from tidelog.llm import common
    import pyarrow as pa

    texts = ["", None, "a", " a b ", "é\x0bx" * 50, "word " * 300, "y" * 500, "\t", "z" * 130 + " " + "q" * 70]
    whole, at = word_hashes(*common.utf8(pa.array(texts)))
    assert np.diff(at).tolist() == [len(words(t)) for t in texts]
    monkeypatch.setattr(common, "_CHUNK", 128)
    parts, at2 = word_hashes(*common.utf8(pa.array(texts)))
    assert at.tolist() == at2.tolist()
    short = np.array([len(w.encode()) <= 64 for t in texts for w in words(t)])
    assert (whole[short] == parts[short]).all()


# --------------------------------------------------------------------------- similarity join


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets.setdefault(i, frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]))
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent", "block", "blocks", "n_grams"), [(4, 85, 400, 64, 4_000_000), (5, 80, 400, 64, 4_000_000), (4, 85, 3, 64, 4_000_000), (1, 50, 4, 2, 4_000_000), (4, 85, 2, 2, 300)])
def test_join_equals_brute_force(spark, monkeypatch, k, percent, block, blocks, n_grams):
    for name, value in (("_BLOCK", block), ("_BLOCKS", blocks), ("_BLOCK_GRAMS", n_grams)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(k + percent)
    got = ngram_join.join(frame(spark, rows), Stage(spark, "test"), k, percent).collect()
    assert len(got) == len(rows)
    want = brute_components(rows, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize(("small", "tiles", "k", "percent"), [(0, 1, 5, 80), (15, 2, 2, 85), (60, 1, 5, 80), (1_000, 1, 1, 60)])
def test_join_by_either_order_equals_brute_force(spark, monkeypatch, small, tiles, k, percent):
    """Sets about the size at which the order changes, in classes of several blocks."""
    for name, value in (("_SMALL", small), ("_TILES", tiles), ("_BLOCK", 2), ("_BLOCKS", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(small + percent)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(9)) for _ in range(m)] for m in (14, 18, 40, 70)]
    rows = [*corpus(small + k, 60)]
    for i in range(1_000, 1_080):
        w = list(base[i % 4])
        w = w[: len(w) - rng.randrange(len(w) // 4)]
        for _ in range(rng.randrange(2)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        rows.append((i, " ".join(w)))
    got = ngram_join.join(frame(spark, rows), Stage(spark, "test"), k, percent).collect()
    want = brute_components(rows, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert sum(i != c for i, (_, c) in want.items()) > 30


class Sizes(Stage):
    """Keeps the number of rows of each table."""

    def __init__(self, spark, what):
        super().__init__(spark, what)
        self.rows = {}

    def save(self, df, name):
        out = super().save(df, name)
        self.rows[name] = out.count()
        return out


def test_phrases_shared_by_chance_make_no_family(spark):
    """Unlike texts in a chain, each with a phrase of the one before, and one phrase in all: none of them is compared."""
    own = lambda i: [f"o{i}x{j}" for j in range(28)]
    phrase = lambda i: [f"p{i}y{j}" for j in range(8)]
    chain = [(i, " ".join([*phrase(i), *own(i)[:14], "and", "so", "on", "as", "was", "said", *own(i)[14:], *phrase(i + 1)])) for i in range(150)]
    twins = [(1_000, "one two three four five six seven eight nine ten eleven"), (1_001, "one two three four five six seven eight nine ten eleven twelve")]
    stage = Sizes(spark, "test")
    got = {r.doc_id: r.component_id for r in ngram_join.join(frame(spark, chain + twins), stage, 5, 80).collect()}
    assert got == {i: i for i, _ in chain} | {1_000: 1_000, 1_001: 1_000}
    assert stage.rows["full"] == 2


def test_large_class_is_copied_to_few_products(spark):
    """10,000 short sets are a few blocks, not one for each 400 of them."""
    rows = [(1, 20, i, 20, 1, bytearray(np.arange(20, dtype="<u8").tobytes())) for i in range(10_000)]
    full = spark.createDataFrame(rows, "family long, size int, v long, n long, copies long, grams binary")
    assert ngram_join._dealt(full).count() == 3 * 10_000


def test_overlaps_of_thick_and_thin_columns():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, 50).astype("<u8")) for _ in range(90)]
    got = ngram_join.overlaps(ngram_join._columns(sets[:70]), 70, ngram_join._columns(sets[20:]), 70)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:70]]).all()


@pytest.mark.parametrize(("tile", "n_grams"), [(400, 1_000_000), (7, 1_000_000), (400, 90)])
@pytest.mark.parametrize("sides", [1, 2])
def test_product_in_tiles(monkeypatch, tile, n_grams, sides):
    """Numbers of links and what they connect don't depend on the tiles."""
    monkeypatch.setattr(ngram_join, "_BLOCK", tile)
    monkeypatch.setattr(ngram_join, "_TILE_GRAMS", n_grams)
    rng = np.random.default_rng(tile + sides)
    base = [rng.integers(0, 1 << 60, 40).astype("<u8") for _ in range(5)]
    sets = [np.unique(np.concatenate([base[i % 5][rng.random(40) < 0.95], rng.integers(0, 1 << 60, 2).astype("<u8")])) for i in range(60)]
    side, copies = rng.integers(0, sides, 60), rng.integers(1, 4, 60)
    linked = np.array([[i != j and (sides == 1 or side[i] != side[j]) and 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    table = pa.table({"side": side, "v": np.arange(60) + 1000, "n": [len(x) for x in sets], "copies": copies, "grams": pa.array([x.tobytes() for x in sets], pa.binary())})
    got = ngram_join._product(85)(table).to_pylist()
    assert {r["a"] - 1000: r["links"] for r in got if r["b"] is None} == {i: int(x) for i, x in enumerate(linked @ copies) if x}
    edges = [(r["a"] - 1000, r["b"] - 1000) for r in got if r["b"] is not None]
    assert edges and all(linked[i, j] for i, j in edges)
    label = np.arange(60)
    parts = 60 - len(edges)  # of a forest
    while (new := np.where(linked, label[None, :], label[:, None]).min(1)).tolist() != label.tolist():
        label = np.minimum(label, new)
    assert len(set(label.tolist())) == parts


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.v: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Stage(spark, "test")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (90, 95, 100)} == {90}


def test_join_of_nothing(spark):
    assert ngram_join.join(frame(spark, corpus()).limit(0), Stage(spark, "test")).count() == 0


# --------------------------------------------------------------------------- repeats


def brute_repeats(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), [x for x, g in zip(w, gone, strict=True) if not g]))
    return out


@pytest.mark.parametrize("window", [13, 5])
def test_repeats_equal_brute_force(spark, window):
    rows = [*corpus(window), (300, "ha " * 50), (301, "ha " * 20), (302, "ha " * 12)]
    got = substring.remove_repeats(frame(spark, rows), Stage(spark, "test"), window)
    assert {"found", "h"} <= set(got.columns)
    found = sorted((r.doc_id, r.n_words, r.n_removed, words(r.text)) for r in got.collect())
    assert found == sorted(brute_repeats(rows, window))


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join(f"q{rng.randrange(900)}" for _ in range(n)) for n in (40, 30, 50, 20))
    rows = [(1, a), (2, "short text"), (2, f"{c} {a}"), (2, f"{c} {a}"), (3, f"{b} {c}"), (3, f"{d} {c[:60]}"), (3, None), (4, f"{a} {d}")]
    got = substring.remove_repeats(frame(spark, rows), Stage(spark, "test"))
    assert sorted((r.doc_id, r.n_words, r.n_removed, words(r.text)) for r in got.collect()) == sorted(brute_repeats(rows, 13))


def test_no_anchor_of_a_common_passage_fills_a_shard(spark, monkeypatch):
    rng = random.Random(3)
    own = lambda: " ".join(f"u{rng.randrange(10**6)}" for _ in range(30))
    line = " ".join(f"w{i}" for i in range(25))
    rows = [*corpus(7), *((i, f"{own()} {line} {own()}") for i in range(1000, 1200)), (1200, "ha " * 300), (1201, "ha " * 300)]
    most = {}
    for hot in (10**9, 50):
        monkeypatch.setattr(substring, "_HOT_WINDOWS", hot)
        stage = Stage(spark, "test")
        substring.repeats(frame(spark, rows), stage).count()
        # windows of the different segments that one key sends to one shard
        segments = spark.read.parquet(stage.path("segments")).filter("seg is not null").dropDuplicates(["seg"])
        most[hot] = segments.groupBy("home").agg(F.sum(F.length("codes") / 4 - 12).alias("n")).agg(F.max("n")).first()[0]
    assert most[10**9] > 200 and most[50] <= 50
    got = substring.remove_repeats(frame(spark, rows), Stage(spark, "test"))
    assert sorted((r.doc_id, r.n_words, r.n_removed, words(r.text)) for r in got.collect()) == sorted(brute_repeats(rows, 13))


def test_rows_without_an_id_stay(spark):
    rows = [(None, "x " * 40), (1, "x " * 40), (2, "x " * 40), (None, None)]
    got = substring.remove_repeats(frame(spark, rows), Stage(spark, "test"))
    assert sorted((r.doc_id or 0, r.n_removed) for r in got.collect()) == [(0, 0), (0, 0), (1, 0), (2, 40)]


def test_fm_index_counts_like_a_scan():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 6, 400), 0)
    owner = rng.integers(0, 50, len(text)) * 10**12
    index = substring.FmIndex(text, 6, owner)
    patterns = np.stack([text[i : i + 6] for i in range(300)] + [rng.integers(1, 6, 6) for _ in range(50)])
    ends = np.arange(len(patterns)) * 6 + 5
    at = lambda p: [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
    for need in (1, 2):
        matched, lo, hi = index.statistics(patterns.reshape(-1), ends, 6, np.full(len(ends), need))
        for p, m, a, b in zip(patterns, matched, lo, hi, strict=True):
            assert b - a == len(at(p[6 - m :])) >= need and (m == 6 or len(at(p[5 - m :])) < need)
        full = matched == 6
        assert 0 < full.sum() < len(patterns)
        assert index.least_owner(lo[full], hi[full]).tolist() == [min(owner[i] for i in at(p)) for p in patterns[full]]


# --------------------------------------------------------------------------- search


@pytest.mark.parametrize("big", [False, True])
def test_top_k_equals_brute_force(spark, monkeypatch, big):
    from tidelog.llm import topk

    if not big:
        monkeypatch.setattr(topk, "_BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 4, 6) / (1 if big else 7)).tolist()) for i in range(400)]
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (500, [1.0, 2.0]), (501, [3.0, 4.0]), (None, [1.0] * 6), (100, rows[100][1])]
    if big:
        rows = [(i, None if v is None else [x if x is None or x != x else x * 1e5 for x in v]) for i, v in rows]
    vectors = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(vectors, every=100).collect()}
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, u in good:
        if q % 100 == 0:
            all_scores = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), i) for i, v in good if i != q and len(v) == len(u))
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(all_scores[:10])}
    assert got == want


@pytest.mark.parametrize("group", [8192, 40])
def test_top_k_of_repeated_ids(spark, monkeypatch, group):
    from tidelog.llm import topk

    monkeypatch.setattr(topk, "_GROUP", group)
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(-3, 4, 5).tolist()) for i in range(150)]
    rows += [(100, [1, 0, 0, 0, 2]), (100, rows[100][1]), (7, [3, 3, 3, 3, 3])] + [(9, [3, 3, 3, 3, 3])] * 4
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = {}
    for r in top_k(vectors, k=3, every=50).collect():
        got.setdefault((r.query_id, r.query_no), []).append((r["rank"], r.vec_id, r.score))
    want = []
    for q, u in {(q, tuple(u)) for q, u in rows if q % 50 == 0}:
        best = sorted((-(1 << 20) * sum(a * b for a, b in zip(u, v, strict=True)), i) for i, v in rows if i != q)[:3]
        want.append((q, [(n + 1, i, -s) for n, (s, i) in enumerate(best)]))
    assert sorted((q, sorted(x)) for (q, _), x in got.items()) == sorted(want)
    assert top_k(vectors.limit(0)).count() == 0


def test_blocks_are_left_out_on_clustered_vectors():
    from tidelog.llm.topk import Blocks

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 64)) * 300
    x = np.floor(centres[rng.integers(0, 60, 8192)] + rng.normal(size=(8192, 64)) * 30)
    ids = np.arange(8192)
    blocks = Blocks(ids, x)
    _, _, scores, visits = blocks.search(ids[:200], x[:200], 10)
    assert visits < 0.2 * 200 * len(blocks.ids)
    full = x[:200] @ x.T
    full[ids[:200], ids[:200]] = -np.inf
    best = np.sort(full, 1)[:, :-11:-1]
    assert (best == scores).all()
    # bounds from elsewhere: fewer visits, and nothing at or above them is lost
    _, _, above, fewer = blocks.search(ids[:200], x[:200], 10, best[:, 4])
    assert fewer <= visits and (above[:, :5] == best[:, :5]).all()


# --------------------------------------------------------------------------- decontamination


def test_hamming_index_finds_all_within_the_radius():
    rng = np.random.default_rng(6)
    prints = rng.integers(0, 2**63, 300).astype(np.uint64)
    queries = np.concatenate([prints[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)) ^ np.uint64(5), rng.integers(0, 2**63, 100).astype(np.uint64)])
    for radius in (0, 3, 8):
        q, p = decontam.HammingIndex(prints, radius).near(queries)
        want = {(i, j) for i in range(200) for j in range(300) if int(queries[i] ^ prints[j]).bit_count() <= radius}
        assert set(zip(q.tolist(), p.tolist(), strict=True)) == want


def test_items_are_found_wherever_they_lie(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([5, 6, 8, 13, 15, 16, 19, 24, 31, 38, 45, 59, 80, 200, 4, 0])]
    items += [(90, None), (91, items[5][1])]
    rows, want = [(0, None), (1, "")], set()
    for d in range(2, 160):
        i, text = rng.choice(items[:14])
        lead, tail = rng.choices(vocabulary, k=rng.randint(0, 40)), rng.choices(vocabulary, k=rng.randint(0, 40))
        if d % 3:
            rows.append((d, " ".join([*lead, text.upper() if d % 2 else text, *tail])))
            want |= {(d, i)} | ({(d, 91)} if i == 5 else set())
        else:
            rows.append((d, " ".join([*lead, *tail])))
    tables = frame(spark, rows), spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, doc_id string")
    got = decontam.find_items(*tables).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.similarity > 0.999 for r in got)
    split = decontam.find_items(*tables, lot=4).collect()
    assert {(r.doc_id, r.item_id) for r in split} == want
    kept = {r.doc_id for r in decontam.drop_found(*tables).collect()}
    assert kept == {i for i, _ in rows} - {d for d, _ in want}
    assert decontam.drop_found(tables[0], tables[1].limit(0)).count() == len(rows)


def brute_items(rows, items, least=0.8):
    """Of all windows as long as an item, cut to the document: best similarity and how many reach ``least``."""
    shingles = lambda w: Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    parts = {i: shingles(words(t.lower())) if len(words(t)) >= 5 else Counter([tuple(words(t.lower()))]) for i, t in set(items) if words(t)}
    seen = Counter(x for c in parts.values() for x in c)
    rare, weight = np.log(1 + len(parts)), {x: np.log(1 + len(parts) / n) for x, n in seen.items()}
    out = {}
    for d, t in rows:
        w = words((t or "").lower())
        for i, c in parts.items():
            if len(k := next(iter(c))) < 5:
                if n := sum(tuple(w[j : j + len(k)]) == k for j in range(len(w))):
                    out[d, i] = (1.0, n)
                continue
            n = sum(c.values()) + 4
            if not c.keys() & shingles(w).keys():
                continue
            all_ = [decontam.similarity(shingles(w[max(0, s) : s + n]), c, weight, rare) for s in range(5 - n, len(w) - 4)]
            if max(all_) >= least - 1e-9:
                out[d, i] = (round(max(all_), 6), sum(x >= least - 1e-9 for x in all_))
    return out


def edited_passages():
    """Items, and documents with one of them in which words were changed, put in or left out."""
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([5, 9, 13, 20, 35, 50, 64, 90, 140, 230, 400])]
    items += [(20 + i, f"{items[i][1]} {' '.join(rng.choices(vocabulary, k=12))}") for i in (3, 4, 5)]  # shared, so of less weight
    items += [(30, "la la la la la la so la la la la la la la mi re")]
    rows = [(0, None), (1, "")]
    for d in range(2, 200):
        w = items[d % len(items)][1].split()
        for _ in range(rng.randint(0, 1 + len(w) // 40)):
            at = rng.choice([0, len(w) - 1, rng.randrange(len(w)), rng.randrange(len(w))])
            kind = rng.randrange(3)
            w[at : at + (kind > 0)] = [rng.choice(vocabulary)] * (kind < 2)
        lead, tail = (rng.choices(vocabulary, k=rng.choice([0, rng.randint(1, 40)])) for _ in "ab")
        rows.append((d, " ".join([*lead, *w, *tail])))
    return rows, items


def test_edited_items_are_found_as_by_brute_force(spark):
    rows, items = edited_passages()
    want = brute_items(rows, items)
    assert len(want) > 100 and sum(s < 0.9 for s, _ in want.values()) > 20
    got = decontam.find_items(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (round(r.similarity, 6), r.n_windows) for r in got} == want


def test_items_of_fewer_than_five_words(spark):
    items = [(1, "one"), (2, "two words"), (3, "Three Words Here"), (4, "now these are four"), (5, "two words"), (6, ""), (7, None), (8, " \n"), (9, "now these are four and more"), (9, "ein anderes")]
    texts = ["one one two words one", "three words", "three words here", "x now these are four", "two", "words two words words", "now these are four and more", "ein anderes", "", None, "four now these are"]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    tables = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in items:
        if t and words(t):
            want |= {(d, i): what for (d, _), what in brute_items(rows, [(i, t)]).items()}
    for lot in (4096, 2):
        got = decontam.find_items(*tables, lot=lot).collect()
        assert {(r.doc_id, r.item_id): (r.similarity, r.n_windows) for r in got} == want
        assert len([r for r in got if r.doc_id == 3]) == 2
    kept = decontam.drop_found(*tables, lot=3)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert "found" in kept.columns


@pytest.mark.parametrize("item", ["ΟΔΟΣ ΚΑΙ ΛΟΓΟΣ ΤΟΥ ΚΟΣΜΟΥ ΣΗΜΕΡΑ", "İstanbul İLE BİR DAHA DA GİDİLEN"])
def test_one_lower_case_for_both_sides(spark, item):
    rows = [(1, f"before {item} behind"), (2, "nothing of it")]
    got = decontam.find_items(frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.similarity) for r in got] == [(1, 1.0)]


def test_lots_do_not_change_what_is_found(spark):
    rows, items = edited_passages()
    tables = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_items(*tables, lot=4).collect()
    want = brute_items(rows, items)
    assert {(r.doc_id, r.item_id): (round(r.similarity, 6), r.n_windows) for r in got} == want
    kept = {r.doc_id for r in decontam.drop_found(*tables, lot=1).collect()}
    assert kept == {i for i, _ in rows} - {d for d, _ in want}


def test_similarity_is_weighted():
    a, b = Counter({1: 2, 2: 1}), Counter({1: 1, 3: 1})
    assert decontam.similarity(a, b, {1: 2.0, 2: 1.0}, 4.0) == 2 / (4 + 1 + 4)


# --------------------------------------------------------------------------- pipeline


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kept, docs = {}, Q.table(spark, sf_dir, "documents")
    stage = Stage(spark, "test-pipeline")
    for name, f in corpus_pipeline.STAGES:
        docs = kept[name] = stage.save(f(spark, docs, sf_dir), name)
    columns = Q.table(spark, sf_dir, "documents").columns
    assert all(kept[n].columns == columns for n in list(kept)[:-1])
    # each stage against brute force over what it was given
    rows = {n: {r.doc_id: r.text for r in kept[n].collect()} for n in list(kept)[:-1]}
    want = brute_components(sorted(rows["toxicity"].items()), 5, 80)
    assert set(rows["ngram_join"]) == {i for i, (_, c) in want.items() if i == c}
    repeats = {i: w for i, _, _, w in brute_repeats(sorted(rows["ngram_join"].items()), 13)}
    assert {i: words(t) for i, t in rows["substring"].items()} == repeats
    items = [(r.item_id, r.text) for r in Q.table(spark, sf_dir, "benchmark").collect()]
    leaked = {d for d, _ in brute_items(sorted(rows["substring"].items()), items)}
    assert leaked and set(rows["decontamination"]) == set(rows["substring"]) - leaked
    pieces = kept["packing"].collect()
    assert {r.doc_id for r in pieces} == set(rows["decontamination"])
    labels = Q.table(spark, sf_dir, "labels").join(Q.table(spark, sf_dir, "documents"), "doc_id", "left_semi").collect()
    for toxic, most in ((1, 0.25), (0, 0.97)):  # few labelled texts to learn from
        known = {r.doc_id for r in labels if r.toxic == toxic}
        left = len(known & set(rows["toxicity"])) / len(known)
        assert left <= most if toxic else left >= most
    assert kept["substring"].filter(F.length("text") != F.col("n_chars")).count() == 0


ODD = [(None, "no id here at all"), (None, None), (1, None), (2, ""), (3, "a b"), (4, "x " * 30), (4, "x " * 30), (5, "other text under an id that is used twice " * 4), (5, "short"), (6, "word " * 300_000), (7, "word " * 300_000)]


@pytest.mark.parametrize("some", [True, False])
def test_stages_take_odd_rows(spark, sf_dir, some):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, t, None, "s", None, 1, "y") for i, t in ODD] if some else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, found int, n_words string")
    kept = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, sf_dir)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    if not some:
        assert not any(kept.values()) and not pieces
        return
    everything = sorted(ODD, key=str)
    assert kept["toxicity"] == everything and kept["decontamination"] == everything
    assert kept["ngram_join"] == [r for r in everything if r[0] != 7]
    cut = [r for r in everything if r[0] != 7] + [(7, "")]
    assert kept["substring"] == sorted(cut, key=str)
    assert {r.doc_id for r in pieces} == {i for i, _ in ODD}
