"""Exact top-k inner products by blocks of documents whose bounds end the search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.stage import Stage

ROWS = "query_id long, query_no long, vec_id long, copies long, score long"
_BLOCK, _GROUP, _QUERIES = 128, 8_192, 8_192
_EXACT = float(1 << 53)


def cohesive(values: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in ranges of at most ``size`` rows that are alike: halved again and again across the longest line.

    The line of a range goes from the row farthest from its mean to the row farthest from that one.
    """
    done, open_ = [], [np.arange(len(values))]
    while open_:
        rows = open_.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        part = values[rows]
        a = part[np.argmax(((part - part.mean(0)) ** 2).sum(1))]
        b = part[np.argmax(((part - a) ** 2).sum(1))]
        order = np.argsort(part @ (b - a), kind="stable")
        half = -(-len(rows) // 2)
        open_ += [rows[order[half:]], rows[order[:half]]]
    return done


class Blocks:
    """Forward index of a group of documents in blocks, with each block's largest and least value by term."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, size: int | None = None):
        cuts = cohesive(values.astype(np.float64), size or _BLOCK)
        self.rows = cuts
        self.ids, self.values = [ids[c] for c in cuts], [values[c] for c in cuts]
        self.high = np.stack([v.max(0) for v in self.values])
        self.low = np.stack([v.min(0) for v in self.values])

    def search(self, keys: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Ids, row numbers and scores of the k best of each query (id -1 and the least score where there are fewer).

        Each query takes the blocks in the order of the sum of its terms' maxima, and ends before
        the first block whose bound is below its k-th score, or below ``floor``, a score that k
        documents elsewhere reach; a bound equal to it may hide a smaller id. Documents below the
        floor may be left out. Also returns how many block visits were needed.
        """
        bound = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        order = np.argsort(-bound, axis=1, kind="stable")
        n = len(keys)
        ids, rows, scores = np.full((n, k), -1, np.int64), np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, queries.dtype)
        floor = np.full(n, -np.inf, queries.dtype) if floor is None else floor
        active, visits = np.arange(n), 0
        for turn in range(len(self.ids)):
            active = active[bound[active, order[active, turn]] >= np.maximum(scores[active, -1], floor[active])]
            if not len(active):
                break
            visits += len(active)
            block = order[active, turn]
            by = np.argsort(block, kind="stable")
            for part in np.split(active[by], np.flatnonzero(np.diff(block[by])) + 1):
                b = int(order[part[0], turn])
                for lot in np.array_split(part, max(1, len(part) // 1024)):
                    self._merge(b, lot, keys, queries, floor, ids, rows, scores)
        return ids, rows, scores, visits

    def _merge(self, b: int, lot: np.ndarray, keys: np.ndarray, queries: np.ndarray, floor: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        got = queries[lot] @ self.values[b].T
        got[keys[lot][:, None] == self.ids[b][None, :]] = -np.inf
        keep = np.flatnonzero((got >= np.maximum(scores[lot, -1], floor[lot])[:, None]).any(1))
        if not len(keep):
            return
        lot, got, k = lot[keep], got[keep], ids.shape[1]
        every = np.concatenate([scores[lot], got], 1)
        names = np.concatenate([ids[lot], np.broadcast_to(self.ids[b], got.shape)], 1)
        where = np.concatenate([rows[lot], np.broadcast_to(self.rows[b], got.shape)], 1)
        none = every == -np.inf
        names = np.where(none, np.iinfo(np.int64).max, names)
        best = np.lexsort((names, -every), axis=1)[:, :k]
        scores[lot], rows[lot] = np.take_along_axis(every, best, 1), np.take_along_axis(where, best, 1)
        ids[lot] = np.where(np.take_along_axis(none, best, 1), -1, np.take_along_axis(names, best, 1))


def _integers(vectors: DataFrame) -> DataFrame:
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(1024 * x.cast("double")).cast("double"))
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", good))
    return rows.select("vec_id", scaled.alias("v")).withColumn("dim", F.size("v"))


def _stack(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim, is_query = table.column("dim")[0].as_py(), table.column("query").to_numpy()
        ids, copies = table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
        values = _stack(table.column("v").chunk(0), dim) if dim else np.zeros((len(ids), 0))
        most = np.abs(values).max(initial=0)
        exact = most * most * max(1, dim) < _EXACT
        if not exact:
            values = np.array([[int(x) for x in row] for row in values.tolist()], object)
        keys, asked, number = ids[is_query], values[is_query], table.column("query_no").to_numpy(zero_copy_only=False)[is_query]
        floor = [-np.inf if x is None else x for x in table.column("floor").filter(table.column("query")).to_pylist()]
        docs = np.flatnonzero(~is_query)
        docs = docs[np.argsort(ids[docs], kind="stable")]
        if not len(keys) or not len(docs):
            keys, best, rows, scores = keys[:0], np.zeros((0, k), np.int64), np.zeros((0, k), np.int64), np.zeros((0, k))
        else:
            best, rows, scores, _ = Blocks(ids[docs], values[docs]).search(keys, asked, k, np.array(floor, np.float64 if exact else object))
        found = scores != -np.inf
        wide = lambda x: np.broadcast_to(x[: len(best), None], best.shape)[found]
        return pa.table({"query_id": wide(keys), "query_no": wide(number).astype(np.int64), "vec_id": best[found], "copies": copies[docs[rows[found]]] if len(docs) else copies[:0], "score": scores[found].astype(np.int64)})

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, stage: Stage | None = None) -> DataFrame:
    """The k highest inner products of floor(1024 * x) for each vector whose vec_id is divisible by ``every``.

    Rows (query_id, query_no, rank, vec_id, score). Candidates are all rows but those of the
    query's own vec_id; ties go to the smaller vec_id. Vectors are only compared with those of
    their own length. Null vec_ids, null vectors and vectors holding null or non-finite values take
    no part; an empty table gives no rows; repeated rows are candidates as often as they occur.
    Each distinct vector of a vec_id is a query of its own: ``query_no``, a hash of the vector,
    tells them apart. Scores are exact: in floats where all sums are below 2**53, else in integers;
    they must fit 64 bits.

    Equal rows are counted first, then documents are dealt at random in groups, and queries in
    sets. Each pair of a group and a query set is one task of bounded size that returns k rows a
    query. The first group is searched before the others: its k-th scores are the bounds with
    which every other search begins.
    """
    stage = stage or Stage(vectors.sparkSession, "top-k")
    rows = _integers(vectors).groupBy("vec_id", "v", "dim").agg(F.count("*").alias("copies"))
    rows = stage.save(rows.withColumn("no", F.xxhash64("v")), "rows")
    is_query = F.col("vec_id") % every == 0
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"))
    # One row for each distinct vector length: how many groups and query sets it is dealt in.
    deal = sizes.select("dim", F.ceil(F.col("n") / _GROUP).cast("int").alias("groups"), F.ceil(F.col("q") / _QUERIES).cast("int").alias("sets")).filter("sets > 0")
    own = lambda n: F.pmod(F.xxhash64("vec_id", "no", F.lit(1)), F.col(n).cast("long")).cast("int")
    searches = deal.agg(F.sum(F.col("groups").cast("long") * F.col("sets"))).first()[0] or 1
    docs = rows.join(deal, "dim").withColumn("group", own("groups"))
    docs = docs.withColumn("set", F.explode(F.sequence(F.lit(0), F.col("sets") - 1)))
    asks = rows.filter(is_query).join(deal, "dim").withColumn("set", own("sets"))

    def searched(first: bool, floors: DataFrame | None) -> DataFrame:
        part = docs.filter("group = 0" if first else "group > 0").select("dim", "group", "set", "vec_id", "v", "copies", F.lit(False).alias("query"), F.lit(None).cast("long").alias("query_no"), F.lit(None).cast("long").alias("floor"))
        mine = asks.withColumn("floor", F.lit(None).cast("long")) if floors is None else asks.join(floors, ["vec_id", "no"], "left")
        groups = F.array(F.lit(0)) if first else F.sequence(F.lit(1), F.col("groups") - 1)
        mine = mine.filter("groups > 1" if not first else "true").withColumn("group", F.explode(groups))
        mine = mine.select("dim", "group", "set", "vec_id", "v", F.lit(0).cast("long").alias("copies"), F.lit(True).alias("query"), F.col("no").alias("query_no"), "floor")
        # a search is small in bytes and long in time: a task for each, not as many as fill a partition
        return part.unionByName(mine).repartition(min(searches, 10_000), "dim", "group", "set").groupBy("dim", "group", "set").applyInArrow(_search(k), ROWS)

    begun = stage.save(searched(True, None), "first")
    floors = begun.groupBy(F.col("query_id").alias("vec_id"), F.col("query_no").alias("no")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    best = begun.unionByName(searched(False, floors))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    order = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "query_no", "rank", "vec_id", "score")
