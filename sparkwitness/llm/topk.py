"""Exact top-k by inner product, by aggregating sorted lists without random access (NRA).

Rows are dealt into blocks; a block holds one list per component, its rows sorted by that component.  A query reads
the lists from the end its weight's sign prefers, a run of every list at a time, and adds up what it has read.  A row's
score is at least what is read of it plus the lowest entry of each list it has not appeared in, and at most that sum
with the entry at which each list now stands.  When even a row not met at all cannot reach the k-th best lower bound, only
rows met whose upper bound does go on; reading stops when few are left, and their scores are resolved.

The k best of smaller parts of the table bound the search in larger ones: rounds hold ``GROWTH`` times the rows of the one
before, so what a round reports grows with the queries and not with queries times rows.  Queries are read in
slices of ``SLICE``, the bound of what a task is sent.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, stored

by_value(__name__)

#: Rows of a block, and runs into which each of its lists is cut.
BLOCK, RUNS = 4096, 32
#: Rows of the first round, and how much larger each next one is.
FIRST, GROWTH = 4096, 8
#: Queries searched at a time, sent to every task: SLICE * (components + 3) * 8 bytes.
SLICE = 16_384
#: Blocks in a task.
BLOCKS = 4
#: Rows of a block whose scores are resolved at once.
FEW = 64
NO_ID, LOWEST = np.iinfo(np.int64).max, np.iinfo(np.int64).min  # a null id stands behind all others


class Lists:
    """Sorted lists over a block of integer rows (double precision holds their products and sums exactly)."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, places: np.ndarray):
        self.rows, self.ids, self.places = rows.astype(float), ids, places
        n = len(rows)
        order = np.argsort(rows, axis=0, kind="stable").T  # components x n, ascending
        values = np.take_along_axis(self.rows.T, order, axis=1)
        # [0]: from the highest entry down, [1]: from the lowest up.
        self.order = np.stack([order[:, ::-1], order])
        self.values = np.stack([values[:, ::-1], values])
        self.stops = np.unique(np.append(np.arange(1, RUNS) * -(-n // RUNS), n).clip(1, n))  # where reading may pause

    def best(self, query: np.ndarray, own: int, k: int, least: tuple[int, int]) -> list[tuple[int, int, int]]:
        """The k best (score, id, place), except the row at place ``own`` and rows not before ``least`` (score, id)."""
        n = len(self.rows)
        used = np.flatnonzero(query)
        weight, side = query[used].astype(float), (query[used] < 0).astype(int)
        heads = self.values[side[:, None], used[:, None], self.stops[None, :] - 1] * weight[:, None]
        unmet = heads.sum(axis=0)  # the most that a row not met by a stop can score
        bar = float(least[0]) if least[0] > LOWEST else -np.inf

        def read_to(stop: int) -> np.ndarray:
            order, values = self.order[side, used, :stop], self.values[side, used, :stop]
            return np.bincount(order.ravel(), (values * weight[:, None]).ravel(), minlength=n).astype(float)

        if bar == -np.inf:  # no bound yet: what half the lists say names k rows, whose scores are one
            read = read_to(int(self.stops[len(self.stops) // 2]))
            read[self.places == own] = -np.inf
            if n > k + 1:
                some = np.argpartition(read, n - k)[n - k:]
                bar = float((self.rows[some] @ query).min())
        # Rows not met are out below the bar; on to below 0, most rows that were met are out as well.
        below = np.flatnonzero(unmet < min(bar, 0.0))
        pause = int(below[0]) if len(below) else len(self.stops) - 1
        stop = int(self.stops[pause])
        read, head = read_to(stop), heads[:, pause]
        # Upper bounds of all rows: what is read of them, and the lists' heads where they were not met.
        met = np.bincount(self.order[side, used, :stop].ravel(), np.repeat(head, stop), minlength=n)
        alive = np.flatnonzero(read + unmet[pause] - met >= bar - 0.5)
        entries = self.rows[alive[:, None], used] * weight
        while len(alive) > FEW and stop < n:  # read on, of the rows that still may qualify
            pause = min(pause + 1, len(self.stops) - 1)
            stop, head = int(self.stops[pause]), heads[:, pause]
            upper = np.maximum(entries, head).sum(axis=1)  # entries not read yet lie below the head
            alive, entries = alive[upper >= bar - 0.5], entries[upper >= bar - 0.5]
        scores = (self.rows[alive] @ query).astype(np.int64)  # resolved
        ids, places = self.ids[alive], self.places[alive]
        fit = (places != own) & ((scores > least[0]) | ((scores == least[0]) & (ids < least[1])))
        scores, ids, places = scores[fit], ids[fit], places[fit]
        order = np.lexsort((places, ids, -scores))[:k]
        return [(int(scores[j]), int(ids[j]), int(places[j])) for j in order]


def _grid(vector: str, scale: int) -> F.Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def search(
    vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100, key: str = "vec_id", vector: str = "embedding",
    block: int = BLOCK, first: int = FIRST, growth: int = GROWTH, slice_size: int = SLICE, blocks: int = BLOCKS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by ``every`` the k other rows of highest inner product.

    Components count as ``floor(scale * x)`` in whole numbers.  Ties go to the smaller key, a null key last; rows that share
    their key are told apart, each is a query and may be the other's answer.  Vectors that are null, empty, or hold null or
    non-finite components take no part, nor do vectors with a component beyond ``limit`` (the largest for which a score
    always fits a long and is exact).  Vectors of different lengths do not meet.  With fewer than k other rows all are
    returned.  Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (F.size("v") > 0)
    # 2 ** 52 over the length: sums of products stay exact in double precision.
    small = F.forall("v", lambda e: F.abs(e.cast("double") * scale) * F.sqrt(F.size("v").cast("double")) < float(2 ** 26 - 2))
    given = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).where(F.coalesce(fine, F.lit(False)) & F.coalesce(small, F.lit(False)))
    place = F.monotonically_increasing_id()
    rows = stored(given.select("id", _grid("v", scale).alias("x")).withColumn("place", place).withColumn("deal", F.xxhash64("place")), "topk-rows")
    sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect()}
    parts = []
    for d, n in sorted(sizes.items()):
        parts.extend(_searched(rows.where(F.size("x") == d), d, n, k, every, block, first, growth, slice_size, blocks))
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("query_id", "rank", "vec_id", "score")


def _searched(rows: DataFrame, d: int, n: int, k: int, every: int, block: int, first: int, growth: int, slice_size: int, blocks: int) -> list[DataFrame]:
    """Results of the rows of one length, a table per slice of queries."""
    spark = rows.sparkSession
    # Shares of the rows per round, as bounds on a hash of their place: first / n, then growth times as much.
    shares, share = [], min(1.0, first / n)
    while share < 1.0:
        shares.append(share)
        share *= growth
    shares.append(1.0)
    queries = rows.where(F.col("id") % every == 0).select("place", "id", "x")
    n_slices = max(1, -(-queries.count() // slice_size))
    out = []
    for s in range(n_slices):
        mine = queries.where(F.pmod(F.xxhash64("place", F.lit(1)), F.lit(n_slices)) == s).orderBy("place").collect()
        if not mine:
            continue
        places = np.array([r["place"] for r in mine], dtype=np.int64)
        asked = np.array([r["x"] for r in mine], dtype=np.int64)
        least = np.full((len(mine), 2), (LOWEST, NO_ID), dtype=np.int64)
        found, low = None, 0.0
        for r, high in enumerate(shares):
            sent = spark.sparkContext.broadcast((places, asked, least.copy()))
            span = (F.pmod(F.col("deal"), F.lit(1 << 30)) >= int(low * (1 << 30))) & (F.pmod(F.col("deal"), F.lit(1 << 30)) < int(high * (1 << 30)))
            expected = max(1.0, n * (high - low))
            tasks = max(1, int(-(-expected // (block * blocks))))
            dealt = rows.where(span).repartition(tasks, "deal")
            new = dealt.select("place", "id", "x").mapInArrow(_reader(sent, d, k, block), "query bigint, place bigint, id bigint, score bigint")
            both = new if found is None else new.unionByName(found)
            best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "place")
            found = stored(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "place", "id", "score", "rank") if r == len(shares) - 1
                           else both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "topk-best")
            low = high
            if r < len(shares) - 1:
                worst = found.groupBy("query").agg(F.count("*").alias("n"), F.max_by(F.struct("score", "id"), F.struct(-F.col("score"), F.coalesce("id", F.lit(NO_ID)))).alias("w")).where(F.col("n") >= k).collect()
                at = {p: j for j, p in enumerate(places.tolist())}
                for row in worst:
                    least[at[row["query"]]] = (row["w"]["score"], NO_ID if row["w"]["id"] is None else row["w"]["id"])
            sent.unpersist()
        names = queries.select(F.col("place").alias("query"), F.col("id").alias("query_id"))
        out.append(found.withColumnRenamed("id", "vec_id").join(names, "query").select("query_id", "rank", "vec_id", "score"))
    return out


def _reader(sent, d: int, k: int, block: int):
    """A task: blocks of rows, one after another; each query keeps its k best of all of them."""
    def run(batches):
        import heapq

        import pyarrow as pa

        places, asked, least = sent.value
        best: list[list[tuple[int, int, int]]] = [[] for _ in places]  # (score, -id, -place), the worst first

        def search_block(parts):
            x, ids, where = (np.concatenate(c) for c in zip(*parts, strict=True))
            lists = Lists(x, ids, where)
            for j in range(len(places)):
                held = best[j]
                bound = (int(least[j, 0]), int(least[j, 1]))
                if len(held) == k:
                    bound = max(bound, (held[0][0], -held[0][1]), key=lambda b: (b[0], -b[1]))
                for score, i, p in lists.best(asked[j], int(places[j]), k, bound):
                    entry = (score, -i, -p)
                    if len(held) < k:
                        heapq.heappush(held, entry)
                    elif entry > held[0]:
                        heapq.heapreplace(held, entry)

        parts, size = [], 0
        for batch in batches:
            x = batch.column(2)
            values = np.asarray(x.flatten(), dtype=np.int64).reshape(-1, d)
            ids = np.asarray(batch.column(1).fill_null(NO_ID), dtype=np.int64)
            where = np.asarray(batch.column(0), dtype=np.int64)
            at = 0
            while at < len(where):
                to = min(len(where), at + block - size)
                parts.append((values[at:to], ids[at:to], where[at:to]))
                size, at = size + to - at, to
                if size == block:
                    search_block(parts)
                    parts, size = [], 0
        if parts:
            search_block(parts)
        step = 4096
        for at in range(0, len(places), step):
            rows = [(int(places[j]), -p, None if -i == NO_ID else -i, s) for j in range(at, min(len(places), at + step)) for s, i, p in best[j]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query", "place", "id", "score"])

    return run


ORACLE = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
flat AS (SELECT vec_id, unnest(x) AS c, unnest(range(0, len(x))) AS d FROM good),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(sum(q.c * r.c) AS BIGINT) AS score
  FROM flat q JOIN flat r ON q.d = r.d AND q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id GROUP BY q.vec_id, r.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
