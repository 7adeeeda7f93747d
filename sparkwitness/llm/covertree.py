"""Embedding near-duplicates by dual traversal of cover trees.

Unit vectors are compared by chord length, a metric, so ``cosine >= t`` is ``distance <= sqrt(2 - 2 t)``.
A tree nests levels of centres whose covering radii halve.  The top of the tree is grown on a bounded
sample and only lays out the rows: all rows descend it, are range-partitioned in its order, and are cut
into blocks with measured centre and radius.  Every block holds its own tree over all its rows.  Pairs of nodes, from
shards to blocks to tree nodes, are dropped when their balls are farther apart than the threshold, taken whole when they
cannot be, and opened otherwise; what is left is compared exactly.  A group of any size is many blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, stored
from .graph import components
from .tokens import to_arrow_schema

by_value(__name__)

#: Vectors from which the top of the tree is grown, over all groups; it shapes blocks, not results.
SAMPLE = 1024
BLOCK = 512
SLACK = 1e-7  # rounding of distances: bounds are never tighter than this

NODES = "center array<int>, radius array<double>, first array<int>, last array<int>, child array<int>, kids array<int>"


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


class CoverTree:
    """Nodes in breadth-first order; a node covers the rows ``order[first:last]`` within ``radius`` of ``center``."""

    def __init__(self, x: np.ndarray, smallest: float):
        self.order = np.arange(len(x))
        d = distances(x, x[:1])[:, 0]
        self.center, self.radius, self.first, self.last = [0], [float(d.max())], [0], [len(x)]
        self.child, self.kids = [0], [0]
        level = {0: 1.0}
        at = 0
        while at < len(self.center):
            lo, hi, r = self.first[at], self.last[at], level[at]
            if self.radius[at] > smallest and hi - lo > 1:
                rows = self.order[lo:hi]
                while self.radius[at] <= r:  # levels at which the node is its own only child
                    r /= 2
                # Nesting: the centre stays one; then the farthest row until all are covered.
                picks = [self.center[at]]
                near = distances(x[rows], x[picks])[:, 0]
                owner = np.zeros(len(rows), dtype=int)
                while near.max() > r:
                    new = int(near.argmax())
                    picks.append(int(rows[new]))
                    d = distances(x[rows], x[rows[new:new + 1]])[:, 0]
                    closer = d < near
                    closer[new] = True
                    near[closer], owner[closer] = d[closer], len(picks) - 1
                    near[new] = 0.0
                sort = np.argsort(owner, kind="stable")
                self.order[lo:hi] = rows[sort]
                sizes = np.bincount(owner, minlength=len(picks))
                ends = lo + np.cumsum(sizes)
                self.child[at] = len(self.center)
                for k, pick in enumerate(picks):
                    if not sizes[k]:
                        continue
                    level[len(self.center)] = r / 2
                    self.center.append(pick)
                    self.radius.append(float(near[owner == k].max()))
                    self.first.append(int(ends[k] - sizes[k]))
                    self.last.append(int(ends[k]))
                    self.child.append(0)
                    self.kids.append(0)
                    self.kids[at] += 1
            at += 1

    def descend(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The leaf of every row, as its place in the tree's own order."""
        place = np.zeros(len(rows), dtype=np.int64)
        stack = [(0, np.arange(len(rows)))]
        while stack:
            node, held = stack.pop()
            if not len(held):
                continue
            if not self.kids[node]:
                place[held] = self.first[node]
                continue
            kids = np.arange(self.child[node], self.child[node] + self.kids[node])
            best = distances(rows[held], x[[self.center[k] for k in kids]]).argmin(axis=1)
            stack += [(int(kids[j]), held[best == j]) for j in range(len(kids))]
        return place


def linked(a: dict, b: dict, threshold: float) -> np.ndarray:
    """Rows of ``a`` by rows of ``b``: whether their cosine reaches the threshold; rows are in tree order."""
    x, y = a["x"], b["x"]
    far = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))
    out = np.zeros((len(x), len(y)), dtype=bool)
    p, q = np.zeros(1, dtype=int), np.zeros(1, dtype=int)
    while len(p):
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", x[a["center"][p]], y[b["center"][q]])))
        reach = a["radius"][p] + b["radius"][q]
        for i in np.flatnonzero(d + reach <= far - SLACK):  # all of both
            out[a["first"][p[i]]:a["last"][p[i]], b["first"][q[i]]:b["last"][q[i]]] = True
        open_ = (d - reach <= far + SLACK) & ~(d + reach <= far - SLACK)
        p, q = p[open_], q[open_]
        leaf = (a["kids"][p] == 0) & (b["kids"][q] == 0)
        # Opening the wider node; its children may be many, and then a product is cheaper than pairs of nodes.
        wide = (a["radius"][p] >= b["radius"][q]) & (a["kids"][p] > 0) | (b["kids"][q] == 0)
        grown = np.where(leaf, 1, np.where(wide, a["kids"][p], b["kids"][q]))
        dense = leaf if grown.sum() <= max(4096, len(x) * len(y) // 16) else np.ones(len(p), dtype=bool)
        if dense.all() and len(p):
            rows = np.zeros(len(x) + 1, dtype=int)
            np.add.at(rows, a["first"][p], 1), np.add.at(rows, a["last"][p], -1)
            cols = np.zeros(len(y) + 1, dtype=int)
            np.add.at(cols, b["first"][q], 1), np.add.at(cols, b["last"][q], -1)
            r, c = np.flatnonzero(np.cumsum(rows)[:-1]), np.flatnonzero(np.cumsum(cols)[:-1])
            out[np.ix_(r, c)] |= x[r] @ y[c].T >= threshold
            break
        for i in np.flatnonzero(dense):
            r, c = slice(a["first"][p[i]], a["last"][p[i]]), slice(b["first"][q[i]], b["last"][q[i]])
            out[r, c] |= x[r] @ y[c].T >= threshold
        p, q, wide, grown = p[~dense], q[~dense], wide[~dense], grown[~dense]
        step = np.arange(grown.sum()) - np.repeat(np.cumsum(grown) - grown, grown)
        wide = np.repeat(wide, grown)
        p, q = np.repeat(p, grown), np.repeat(q, grown)
        p, q = np.where(wide, a["child"][p] + step, p), np.where(wide, q, b["child"][q] + step)
    return out


def _smallest_linked(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id reachable within a square link matrix, per row."""
    low = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        new = np.minimum(low, np.where(link, low[None, :], top).min(axis=1))
        if (new == low).all():
            return low
        low = new


def _apart(c: str, d: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(c, d, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", group: str = "label",
    sample: int = SAMPLE, block: int = BLOCK,
) -> DataFrame:
    """One row per given row: (key, n_links, component_id, kept).  Rows link within equal, known groups at the threshold.

    ``n_links`` counts the other rows linked directly; ``component_id`` is the smallest key reachable.  Null,
    empty and zero vectors, vectors with null or non-finite parts, and rows with a null group or key link with nothing;
    vectors of different lengths do not link.  Equal rows are compared once and counted all.  Other columns are ignored;
    an empty table gives no rows.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v"), F.col(f"`{group}`").cast("string").alias("g"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    good = given.where(F.col("id").isNotNull() & F.col("g").isNotNull() & F.coalesce(fine, F.lit(False)))
    good = good.withColumn("g", F.concat_ws(":", F.size("v").cast("string"), "g"))
    classes = stored(good.groupBy("g", "v").agg(F.min("id").cast("long").alias("id"), F.count("*").alias("w")), "vector-classes")

    # The top of the tree, from the vectors with the smallest hashes.
    tops: dict[str, tuple] = {}
    chosen = classes.select("g", "v", "id").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    for g in sorted({r["g"] for r in chosen}):
        x = unit(np.array([r["v"] for r in chosen if r["g"] == g], dtype=float))
        tops[g] = (CoverTree(x, 0.0), x)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            names, vs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            places = np.zeros(len(names), dtype=np.int64)
            for g in set(names) & set(tops):
                rows = np.flatnonzero([n == g for n in names])
                places[rows] = tops[g][0].descend(tops[g][1], unit(np.array([vs[i] for i in rows], dtype=float)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(places)], names=["id", "g", "v", "w", "place"])

    v_type = classes.schema["v"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = (
        classes.select("id", "g", "v", "w").mapInArrow(place, f"id long, g string, v {v_type}, w long, place long")
        .repartitionByRange(parts, "g", "place", F.xxhash64("id")).sortWithinPartitions("g", "place", F.xxhash64("id"))
        .withColumn("shard", F.spark_partition_id())
    )
    block_ddl = f"shard int, block int, g string, ids array<bigint>, w array<bigint>, x binary, mid array<double>, reach double, {NODES}"
    block_schema = to_arrow_schema(block_ddl)

    def cut(batches):
        import pyarrow as pa

        held: list = []
        number = 0

        def close():
            nonlocal number, held
            x = unit(np.array([r[2] for r in held], dtype=float))
            tree = CoverTree(x, 0.05)
            x = x[tree.order]
            back = np.empty(len(x), dtype=int)
            back[tree.order] = np.arange(len(x))
            mid = x.mean(axis=0)
            row = {
                "shard": held[0][5], "block": number, "g": held[0][1], "ids": [held[i][0] for i in tree.order], "w": [held[i][3] for i in tree.order],
                "x": x.tobytes(), "mid": mid, "reach": float(np.sqrt(((x - mid) ** 2).sum(axis=1)).max()),
                "center": back[tree.center], "radius": tree.radius, "first": tree.first, "last": tree.last, "child": tree.child, "kids": tree.kids,
            }
            held, number = [], number + 1
            return pa.RecordBatch.from_pylist([row], schema=block_schema)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (len(held) == block or held[0][1] != row[1]):
                    yield close()
                held.append(row)
        if held:
            yield close()

    blocks = stored(laid.mapInArrow(cut, block_ddl), "vector-blocks")
    far = F.lit(float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold))) + SLACK)

    # Dual traversal: shards, blocks, tree nodes.
    balls = blocks.select("g", "shard", "block", "mid", "reach")
    heads = balls.groupBy("g", "shard").agg(F.min_by("mid", "block").alias("top"))
    shards = balls.join(heads, ["g", "shard"]).groupBy("g", "shard").agg(
        F.min_by("mid", "block").alias("top"), F.max(_apart("mid", "top") + F.col("reach")).alias("wide"))
    s, t = (shards.select("g", F.col("shard").alias(f"s{i}"), F.col("top").alias(f"t{i}"), F.col("wide").alias(f"w{i}")) for i in (1, 2))
    shard_pairs = s.join(t, "g").where((F.col("s1") <= F.col("s2")) & (_apart("t1", "t2") - F.col("w1") - F.col("w2") <= far)).select("g", "s1", "s2")
    b, c = (balls.select("g", F.col("shard").alias(f"s{i}"), F.col("block").alias(f"b{i}"), F.col("mid").alias(f"m{i}"), F.col("reach").alias(f"r{i}")) for i in (1, 2))
    pairs = shard_pairs.join(b, ["g", "s1"]).join(c, ["g", "s2"]).where(
        ((F.col("s1") < F.col("s2")) | (F.col("b1") <= F.col("b2"))) & (_apart("m1", "m2") - F.col("r1") - F.col("r2") <= far)
    ).select("s1", "b1", "s2", "b2")
    payload = F.struct("ids", "w", "x", *[f.split()[0] for f in NODES.split(", ")])
    one = blocks.select(F.col("shard").alias("s1"), F.col("block").alias("b1"), payload.alias("p"))
    two = blocks.select(F.col("shard").alias("s2"), F.col("block").alias("b2"), payload.alias("q"))
    met = pairs.join(one, ["s1", "b1"]).join(two, ["s2", "b2"]).select("p", "q", ((F.col("s1") == F.col("s2")) & (F.col("b1") == F.col("b2"))).alias("same"))

    def load(p: dict) -> dict:
        n = len(p["ids"])
        ints = {k: np.array(p[k], dtype=int) for k in ("center", "first", "last", "child", "kids")}
        return ints | {
            "ids": np.array(p["ids"], dtype=np.int64), "w": np.array(p["w"], dtype=np.int64), "x": np.frombuffer(p["x"]).reshape(n, -1),
            "radius": np.array(p["radius"], dtype=float),
        }

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                one_row = batch.slice(i, 1).to_pylist()[0]
                a = load(one_row["p"])
                b = a if one_row["same"] else load(one_row["q"])
                link = linked(a, b, threshold)
                if one_row["same"]:
                    link = link | link.T
                    np.fill_diagonal(link, False)
                rows, cols = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
                if not len(rows):
                    continue
                if one_row["same"]:
                    ids, counts = a["ids"][rows], link[rows] @ a["w"]
                    low = _smallest_linked(link[np.ix_(rows, rows)], ids)
                else:
                    ids = np.concatenate([a["ids"][rows], b["ids"][cols]])
                    counts = np.concatenate([link[rows] @ b["w"], link[:, cols].T @ a["w"]])
                    n, m = len(rows), len(cols)
                    both = np.zeros((n + m, n + m), dtype=bool)
                    both[:n, n:] = link[np.ix_(rows, cols)]
                    low = _smallest_linked(both | both.T, ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts.astype(np.int64)), pa.array(low)], names=["id", "links", "low"])

    found = stored(met.mapInArrow(compare, "id long, links long, low long"), "vector-links")
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("id").alias("u"), F.col("low").alias("v")))
    by_class = classes.join(sums, "id", "left").join(labels, "id", "left").select(
        F.col("g").alias("_g"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"),
    )
    rows = given.withColumn("gv", F.when(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)), F.concat_ws(":", F.size("v").cast("string"), "g")))
    rows = rows.withColumn("gv", F.when(F.col("g").isNotNull(), F.col("gv")))
    out = rows.join(by_class, (rows["gv"] == by_class["_g"]) & (rows["v"] == by_class["_v"]), "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
