"""A Merkle manifest of a dataset, folded from copied SHA-256 states.

Rows are leaves, ``FAN`` consecutive nodes of a source make a parent, the subroots of all sources make the root.
A parent hashes its children one after another and retains a copy of the hash state before each child slot, so
folding a changed child resumes the state of its slot with the replacement and the siblings to its right only; what
stands to the left is never hashed again.

Spark does the work in both directions.  Leaves are hashed in the JVM, ranked in their source by a range
partitioning with offsets per partition, and climb in groups of ``FAN ** LEVELS`` nodes: a group is one call and gives
one node of the next round.  Going down, each group meets the one row that describes its path above (siblings per level), so
a row's path is never shipped per leaf.  A source of any size is many groups; no task holds more than one of them.
"""

from __future__ import annotations

import hashlib
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, stored

by_value(__name__)

FAN = 16
#: Levels that one group climbs at once: FAN ** LEVELS nodes in a task.
LEVELS = 2

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = "doc_id {id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PATH = "g string, i bigint, subroot string, lefts array<binary>, rights array<binary>"


class Parent:
    """One node over at most ``FAN`` children (hex digests as bytes)."""

    def __init__(self, children: list[bytes]):
        self.children = children
        self.before = []  # the hash state before each child slot
        state = hashlib.sha256()
        for child in children:
            self.before.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()
        self.rest = [b"".join(children[k + 1:]) for k in range(len(children))]

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in the slot."""
        state = self.before[slot].copy()
        state.update(child)
        state.update(self.rest[slot])
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> tuple[bytes, bytes]:
        return b"".join(self.children[:slot]), self.rest[slot]


class Step:
    """A slot of a parent whose children are elsewhere: the state before the slot, and what is right of it."""

    def __init__(self, left: bytes, right: bytes):
        self.before, self.right, self.around = hashlib.sha256(left), right, left + right

    def fold(self, child: bytes) -> bytes:
        state = self.before.copy()
        state.update(child)
        state.update(self.right)
        return state.hexdigest().encode()


def climb(nodes: list[bytes], levels: int) -> list[list[Parent]]:
    """Parents of consecutive nodes, level by level; a last run may be short, even one node."""
    found = []
    for _ in range(levels):
        row = [Parent(nodes[k:k + FAN]) for k in range(0, len(nodes), FAN)]
        found.append(row)
        nodes = [p.digest for p in row]
    return found


def levels_of(n: Column) -> Column:
    """Levels above ``n`` nodes: the smallest L with FAN ** L >= n, in whole numbers."""
    level = F.lit(0)
    for k in range(15):
        level = level + F.when(n > F.lit(FAN ** k).cast("long"), 1).otherwise(0)
    return level


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def is_tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with ``i``, the number of a row within its ``g`` in the given order, from 0.

    A range partitioning spreads a group of any size; the offsets are one row per group and partition.
    """
    place = F.monotonically_increasing_id()
    laid = stored(
        nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("_place", place)
        .withColumn("_part", F.shiftright("_place", 33)), "merkle-ranked",
    )
    counts = laid.groupBy("g", "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("g", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return laid.join(starts, ["g", "_part"]).withColumn("i", F.col("_place") + F.col("_shift")).drop("_place", "_part", "_shift")


def _rows(tables) -> dict[str, list]:
    """Columns of a group's Arrow table, ordered by ``i``."""
    table = tables.sort_by("i") if tables.num_rows > 1 else tables
    return {n: table.column(n).to_pylist() for n in table.column_names}


def raise_forest(nodes: DataFrame, sizes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes`` (g, i, digest) and ``sizes`` (g, levels) -> rounds; the last holds one node per g, its root.

    Each round is stored as (g, i, chunk, climbs, digest, other columns); a node that is already a root climbs 0 levels.
    """
    width = FAN ** LEVELS

    def top(key, tables):
        import pyarrow as pa

        rows = _rows(tables)
        nodes_here, levels = [d.encode() for d in rows["digest"]], rows["climbs"][0]
        digest = climb(nodes_here, levels)[-1][0].digest.decode() if levels else rows["digest"][0]
        return pa.table({"g": pa.array([rows["g"][0]], pa.string()), "i": pa.array([rows["chunk"][0]], pa.int64()), "digest": [digest], "levels": pa.array([rows["levels"][0] - levels], pa.int32())})

    given = nodes.join(sizes.select("g", F.col("levels").cast("int").alias("levels")), "g")
    rounds: list[DataFrame] = []
    while True:
        given = given.withColumn("climbs", F.least("levels", F.lit(LEVELS))).withColumn("chunk", F.floor(F.col("i") / width).cast("long"))
        rounds.append(stored(given, f"{name}-{len(rounds)}"))
        if not rounds[-1].agg(F.max("levels").alias("levels")).first()["levels"]:
            return rounds
        given = rounds[-1].select("g", "chunk", "i", "digest", "climbs", "levels").groupBy("g", "chunk").applyInArrow(
            top, "g string, i bigint, digest string, levels int")


def _inner(tree: list[list[Parent]], k: int) -> tuple[list[bytes], list[bytes]]:
    """Siblings of node ``k`` of a group, per level, to the left and to the right."""
    lefts, rights = [], []
    for row in tree:
        left, right = row[k // FAN].siblings(k % FAN)
        lefts.append(left)
        rights.append(right)
        k //= FAN
    return lefts, rights


def lower_paths(rounds: list[DataFrame], roots: DataFrame) -> DataFrame:
    """``roots`` (g, subroot, lefts, rights: the path above each root) -> the same per chunk of the first round, as PATH."""
    def down(key, nodes, paths):
        import pyarrow as pa

        rows, above = _rows(nodes), paths.to_pylist()[0]
        tree = climb([d.encode() for d in rows["digest"]], rows["climbs"][0])
        out = []
        for k, i in enumerate(rows["i"]):
            lefts, rights = _inner(tree, k)
            out.append({"g": above["g"], "i": i, "subroot": above["subroot"], "lefts": lefts + above["lefts"], "rights": rights + above["rights"]})
        kinds = pa.schema([("g", pa.string()), ("i", pa.int64()), ("subroot", pa.string()), ("lefts", pa.list_(pa.binary())), ("rights", pa.list_(pa.binary()))])
        return pa.Table.from_pylist(out, schema=kinds)

    paths = roots.select("g", F.lit(0).cast("long").alias("i"), "subroot", "lefts", "rights")
    for nodes in reversed(rounds[1:]):
        paths = nodes.select("g", "chunk", "i", "digest", "climbs").groupBy("g", "chunk").cogroup(paths.groupBy("g", "i")).applyInArrow(down, PATH)
    return paths


def manifest(documents: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per given row.

    A null field is ``-``; a null source is a source of its own, the first.  Rows of one source ascend by doc_id, null first;
    rows that share it stand in the order of their leaves.  A row under a null id is never tampered.  A lone leaf is its
    subroot, a lone subroot the root, and a proof without siblings the hash of nothing.  Other columns are ignored; an empty table
    gives no rows.
    """
    doc_id, source, lang, n_chars, text = (F.col(f"`{c}`") for c in FIELDS)
    hit = is_tampered(doc_id)
    leaves = stored(documents.select(
        F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-")).alias("g"),  # sorts as the sources do, null first
        doc_id.alias("doc_id"), leaf_of(doc_id, source, lang, n_chars, text).alias("digest"),
        F.when(hit, leaf_of(doc_id, source, lang, n_chars, lowered(text))).alias("changed"),
    ), "merkle-leaves")
    sizes = leaves.groupBy("g").agg(F.count("*").alias("n")).select("g", levels_of(F.col("n")).alias("levels"))
    rounds = raise_forest(ranked(leaves, "doc_id", "digest"), sizes, "merkle-round")

    # The subroots, in the order of their sources, are the leaves of the last tree.
    subroots = ranked(rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"), "of")
    count = subroots.agg(F.count("*").alias("n")).select(F.lit("").alias("g"), levels_of(F.col("n")).alias("levels"))
    upper = raise_forest(subroots, count, "merkle-top")
    found = upper[-1].first()
    root = found["digest"] if found else ""
    nothing = F.array().cast("array<binary>")
    whole = lower_paths(upper, upper[-1].select("g", F.lit("").alias("subroot"), nothing.alias("lefts"), nothing.alias("rights")))
    slots = whole_paths(upper[0], whole)
    chunks = lower_paths(rounds, slots)

    def fold(key, nodes, paths):
        import pyarrow as pa

        rows, above = _rows(nodes), paths.to_pylist()[0]
        digests = [d.encode() for d in rows["digest"]]
        tree = climb(digests, rows["climbs"][0])
        steps = [Step(left, right) for left, right in zip(above["lefts"], above["rights"], strict=True)]
        upward = b"".join(s.around for s in steps)
        # Siblings above the first level are shared by the rows of a parent.
        beyond = [b"".join(b"".join(pair) for pair in zip(*_inner(tree[1:], k), strict=True)) + upward for k in range(len(tree[0]) if tree else 1)]
        known: dict[tuple, bytes] = {}
        proofs, folded = [], []
        for k, (digest, changed) in enumerate(zip(digests, rows["changed"], strict=True)):
            proof = hashlib.sha256()
            if tree:
                left, right = tree[0][k // FAN].siblings(k % FAN)
                proof.update(left)
                proof.update(right)
            proof.update(beyond[k // FAN])
            proofs.append(proof.hexdigest())
            value, at = changed.encode() if changed is not None else digest, k
            for level, row in enumerate(tree):  # equal replacements of one slot are folded once
                where = (level, at, value)
                if where not in known:
                    known[where] = row[at // FAN].fold(at % FAN, value)
                value, at = known[where], at // FAN
            for level, step in enumerate(steps, len(tree)):
                where = (level, 0, value)
                if where not in known:
                    known[where] = step.fold(value)
                value = known[where]
            folded.append(value.decode())
        n = len(digests)
        return pa.table({
            "doc_id": nodes.sort_by("i").column("doc_id"), "leaf": rows["digest"], "subroot": [above["subroot"]] * n, "root": [root] * n,
            "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
        })

    first = rounds[0].select("g", "chunk", "i", "doc_id", "digest", "changed", "climbs")
    return first.groupBy("g", "chunk").cogroup(chunks.groupBy("g", "i")).applyInArrow(
        fold, RESULT.format(id=first.schema["doc_id"].dataType.simpleString()))


def whole_paths(subroots: DataFrame, paths: DataFrame) -> DataFrame:
    """The path above each subroot, by its source: (g, subroot, lefts, rights)."""
    def down(key, nodes, paths):
        import pyarrow as pa

        rows, above = _rows(nodes), paths.to_pylist()[0]
        tree = climb([d.encode() for d in rows["digest"]], rows["climbs"][0])
        out = []
        for k, (of, digest) in enumerate(zip(rows["of"], rows["digest"], strict=True)):
            lefts, rights = _inner(tree, k)
            out.append({"g": of, "subroot": digest, "lefts": lefts + above["lefts"], "rights": rights + above["rights"]})
        return pa.Table.from_pylist(out, schema=pa.schema([("g", pa.string()), ("subroot", pa.string()), ("lefts", pa.list_(pa.binary())), ("rights", pa.list_(pa.binary()))]))

    return subroots.groupBy("g", "chunk").cogroup(paths.groupBy("g", "i")).applyInArrow(
        down, "g string, subroot string, lefts array<binary>, rights array<binary>")


def _oracle(levels: int = 4, top: int = 4) -> str:
    """SQL for a manifest whose sources hold at most FAN ** levels rows, over at most FAN ** top sources."""
    field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join([field(c) for c in FIELDS[:-1]] + [field(text)]) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = (
        "flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda p: list_transform(range(0, 8), "
        "lambda k: (CAST(ascii(substr(CAST(doc_id AS VARCHAR), p, 1)) AS UBIGINT) >> CAST(k AS UBIGINT)) & 1)))"
    )
    crc = (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {bits}), lambda c, b: CASE WHEN xor(c, b) & 1 = 1 "
        "THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END), CAST(4294967295 AS UBIGINT))"
    )
    parts = [f"""
a0 AS (
  SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS r, doc_id, source, leaf AS d,
    CASE WHEN hit THEN changed ELSE leaf END AS f, leaf,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, '' AS proof
  FROM (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf(lower)} AS changed, coalesce({crc} % 5 = 0, false) AS hit FROM documents))"""]
    # The nodes of a level, and each row's place, proof and folded value in it.
    def step(k: int, key: str, source: str, name: str) -> str:
        run = f"{key}, i // {FAN}"
        return f"""
{name}n{k} AS (SELECT DISTINCT {key} AS s, i, n, d FROM {source}),
{name}p{k} AS (SELECT s, i // {FAN} AS j, sha256(string_agg(d, '' ORDER BY i)) AS up FROM {name}n{k} WHERE n > 1 GROUP BY s, i // {FAN}),
{name}x{k} AS (
  SELECT a.r, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i <> a.i), '') AS around,
    sha256(string_agg(CASE WHEN b.i = a.i THEN a.f ELSE b.d END, '' ORDER BY b.i)) AS fold
  FROM {source} a JOIN {name}n{k} b ON a.{key} IS NOT DISTINCT FROM b.s AND a.i // {FAN} = b.i // {FAN} AND a.n > 1 GROUP BY a.r),
{name}{k + 1} AS (
  SELECT a.* EXCLUDE (d, f, i, n, proof), coalesce(p.up, a.d) AS d, coalesce(x.fold, a.f) AS f, CASE WHEN a.n > 1 THEN a.i // {FAN} ELSE a.i END AS i,
    CASE WHEN a.n > 1 THEN (a.n + {FAN - 1}) // {FAN} ELSE a.n END AS n, a.proof || coalesce(x.around, '') AS proof
  FROM {source} a LEFT JOIN {name}p{k} p ON a.{key} IS NOT DISTINCT FROM p.s AND a.i // {FAN} = p.j AND a.n > 1 LEFT JOIN {name}x{k} x USING (r))"""
    for k in range(levels):
        parts.append(step(k, "source", f"a{k}", "a"))
    parts.append(f"""
t0 AS (
  SELECT r, doc_id, leaf, d AS subroot, d, f, proof, 0 AS one, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS i,
    (SELECT count(*) FROM (SELECT DISTINCT source FROM documents)) AS n FROM a{levels})""")
    for k in range(top):
        parts.append(step(k, "one", f"t{k}", "t"))
    return "WITH " + ",".join(parts) + f"""
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified FROM t{top}"""


ORACLE = _oracle()
