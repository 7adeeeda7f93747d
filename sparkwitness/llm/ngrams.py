"""Exact Jaccard join of word n-gram sets, by set-relation skipping.

Documents with equal sets are one class; only a class's smallest id goes on.  Sets are ordered by one
global order of their n-grams (by hash), and only a prefix of each set is indexed, long enough that two linked sets share
``SHARED`` indexed n-grams or more.  A list is *short* up to ``LONG`` entries.

*Short lists.*  A set with h long-list n-grams in its prefix shares at least ``SHARED - h`` short-list n-grams with any set it
is linked to.  So every link with an end of ``h < SHARED`` is found in short lists, whose pairs are few.

*Long lists.*  Links between two sets that are both full of frequent n-grams (large groups of near copies, documents
made of common passages) are found in an index of those sets only, under an order that puts the frequent n-grams last:

- Skipping by position: lists are cut into blocks of close sizes and positions; a block pair is dropped as a whole
  when the positions left behind the shared n-gram, or the sizes, cannot reach the overlap that is needed.
- Answers from a similar set: sets are first compared with the smallest and the largest id of their size class in a list, the
  leaders.  Sets linked to a common leader are in one component, so no pair among them is needed.  Every other set x is
  described by its difference D(x) from a leader c that most of its lists name; then for sets x and y of one leader

    |x & y| = |c| - |c - x| - |c - y| + |D(x) & D(y)|

  so a link asks for so many common differences, at least one of which is among the first few of either set's, rarest first.
  Only sets of different leaders are still compared by their n-grams.

Every order of n-grams gives the same links; order and limits change cost only.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, drop, let_go, map_texts, slices, stored
from .graph import components

by_value(__name__)

#: Entries of a short list: at least this many, and so many that no more than ``FREQUENT`` lists can be longer.
LONG = 16
FREQUENT = 1 << 21
#: Indexed n-grams that linked sets have in common at least (or all they need), in the main index and in that of long lists.
SHARED, SHARED_LATE = 12, 3
#: Bits of the sieve that lets tasks pass over texts that are not wanted; a fixed size, and only ever too permissive.
SIEVE = 1 << 20


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | bytes, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams, A-Z lower-cased; shorter texts are one n-gram."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    words = raw.lower().split()  # bytes: ASCII case and white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(known) > 150_000:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = _mix(out ^ h[k:len(words) - n + 1 + k])
    return np.unique(out)


def prefix_length(n: int, num: int, den: int, shared: int) -> int:
    """Linked sets share ``shared`` n-grams (or all they need to) among the first so many of either."""
    need = (n * num + den - 1) // den
    return n - need + min(shared, need) if n else 0


def _sketches(documents: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(id, n, set_key, prefix in hash order) of every row of (id, body)."""

    def compute(texts):
        known = WordHashes()
        sizes, keys, prefixes = [], [], []
        for t in texts:
            s = shingle_set(t, width, known)
            sizes.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            prefixes.append(s[:prefix_length(len(s), num, den, SHARED)].view(np.int64))
        return sizes, keys, prefixes

    return map_texts(documents, "body", ["id"], compute, "n bigint, set_key binary, prefix array<bigint>")


def _sieve(ids: DataFrame) -> np.ndarray:
    """A bitmap of ``SIEVE`` bits over hashes of the ids, whatever their number."""
    bit = F.pmod(F.xxhash64("id"), F.lit(SIEVE))
    words = ids.select(F.floor(bit / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("b"))
    out = np.zeros(SIEVE // 64, dtype=np.int64)
    for row in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():  # 16,384 rows at most
        out[row["w"]] = row["b"]
    return out


def _may_be(documents: DataFrame, ids: DataFrame):
    """What ``map_texts`` takes to pass over rows that are not among the ids: few others stay."""
    held = documents.sparkSession.sparkContext.broadcast(_sieve(ids))
    return F.pmod(F.xxhash64("id"), F.lit(SIEVE)), lambda bits: (held.value[bits >> 6] >> (bits & 63)) & 1


def _late_prefixes(documents: DataFrame, ids: DataFrame, width: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """(id, n, set_key, prefix) of rows that may be among the ids, under the order: infrequent n-grams by hash, then frequent ones by hash."""
    held = documents.sparkSession.sparkContext.broadcast(frequent)

    def compute(texts):
        known, late = WordHashes(), held.value
        sizes, keys, prefixes = [], [], []
        for t in texts:
            s = shingle_set(t, width, known)
            sizes.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            is_late = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s if len(late) else np.zeros(len(s), dtype=bool)
            p = prefix_length(len(s), num, den, SHARED_LATE)
            prefixes.append(np.concatenate([s[~is_late][:p], s[is_late]])[:p].view(np.int64))
        return sizes, keys, prefixes

    rows = documents.where("id IS NOT NULL")
    return map_texts(rows, "body", ["id"], compute, "n bigint, set_key binary, prefix array<bigint>", _may_be(documents, ids))


def _packed(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, packed): the compressed texts of rows that may be among the ids, a third of the size of their sets."""

    def compute(texts):
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        return [[press.compress(t.encode("utf-8", "surrogatepass")) for t in texts]]

    return map_texts(documents.where("id IS NOT NULL"), "body", ["id"], compute, "packed binary", _may_be(documents, ids))


def _map_sets(rows: DataFrame, width: int, compute, fields: str) -> DataFrame:
    """(columns of rows but the last two, computed fields); ``compute`` maps the sets of the last two columns, packed texts, to a tuple.

    Rows that follow one another with the same text share its set, so the text that repeats should be what they are joined by.
    """
    n = len(rows.columns) - 2
    names = [*rows.columns[:n], *[f.split()[0] for f in fields.split(", ")]]

    def run(batches):
        import pyarrow as pa
        import zstandard

        let_go()
        known, press = WordHashes(), zstandard.ZstdDecompressor()
        held = [(None, None), (None, None)]
        for batch in slices(batches):
            out = []
            for both in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                for k, packed in enumerate(both):
                    if packed != held[k][0]:
                        held[k] = packed, shingle_set(press.decompress(packed), width, known)
                out.append(compute(held[0][1], held[1][1]))
            arrays = [batch.column(i) for i in range(n)] + [pa.array(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n]]
    return rows.mapInArrow(run, ", ".join([*kept, fields]))


def _needed(a: Column, b: Column, num: int, den: int) -> Column:
    """The least overlap that links sets of these sizes: den * i >= num * (a + b - i)."""
    return F.floor(((a + b) * F.lit(num) + F.lit(num + den - 1)) / F.lit(num + den)).cast("long")


def _reaches(a: str, b: str, num: int, den: int) -> Column:
    """Whether entries ``a`` and ``b`` of one list can belong to linked sets, by sizes and positions.

    At most ``min(pos)`` n-grams are shared up to this one, and ``min(n - pos)`` after it.
    """
    na, nb, pa, pb = (F.col(f"{t}.{c}") for c in ("n", "pos") for t in (a, b))
    return (F.least(pa, pb) + F.least(na - pa, nb - pb)) >= _needed(na, nb, num, den)


def _verify(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b) -> (a, b, na, nb, overlap), by the whole sets."""
    left = texts.select(F.col("id").alias("a"), F.col("packed").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("packed").alias("tb"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")  # many b have one a
    overlap = lambda x, y: (len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))
    return _map_sets(rows, width, overlap, "na bigint, nb bigint, overlap bigint")


def _least(n: Column, num: int, den: int, shared: int) -> Column:
    """Shared entries of a set of this size with any it is linked to."""
    return F.least(F.lit(shared), F.floor((n * num + (den - 1)) / F.lit(den)).cast("int"))


def _lists(leaders: DataFrame) -> DataFrame:
    """Entries (gram, id, n, pos, m) of lists with m > 1 entries, in one shuffle."""
    entries = leaders.select(F.posexplode("prefix").alias("pos", "gram"), "id", "n").select(
        "gram", "id", (F.shiftleft((F.col("pos") + 1).cast("long"), 32) + F.col("n")).alias("at"))
    counted = entries.withColumn("m", F.count("*").over(Window.partitionBy("gram"))).where("m > 1")
    return counted.select("gram", "id", F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("n"), F.shiftright("at", 32).alias("pos"), "m")


def _in_short_lists(entries: DataFrame, limit: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that share as many entries of short lists as links with an end of few long ones do."""
    long = entries.groupBy("id", "n").agg(F.count_if(F.col("m") > limit).alias("h"), F.count("*").alias("all"))
    least = _least(F.col("n"), num, den, SHARED)
    # h stays whole: held to its own set's least, it would ask a larger partner for hits that lie in long lists.
    able = stored(long.where(F.col("all") >= least).select("id", F.col("h").cast("long").alias("h")), "ngram-able")
    short = stored(entries.where(F.col("m") <= limit).join(able, "id"), "ngram-short")
    x, y = (short.select("gram", F.struct("id", "n", "pos", "h").alias(t)) for t in "xy")
    met = x.join(y, "gram").where((F.col("x.id") < F.col("y.id")) & _reaches("x", "y", num, den))
    h = F.least("x.h", "y.h").alias("h")
    counted = met.groupBy("x.id", "y.id", "x.n", "y.n", h).agg(F.count("*").alias("m")).toDF("a", "b", "na", "nb", "h", "m")
    need = F.least(F.lit(SHARED), _needed(F.col("na"), F.col("nb"), num, den)) - F.col("h")
    pairs = stored(counted.where(F.col("m") >= F.greatest(need, F.lit(1))).select("a", "b"), "ngram-pairs")
    drop(able, short)
    return pairs


def _index(leaders: DataFrame, num: int, den: int) -> DataFrame:
    """Entries (gram, id, n, pos, sizes) of the lists of (id, n, prefix) that can still give a link."""
    shared = _lists(leaders).withColumn(
        "sizes", F.floor(F.log(F.col("n")) / F.lit(float(np.log(den / num)))).cast("int") if num < den else F.col("n").cast("int"))
    shared = stored(shared, "ngram-entries")
    able = shared.groupBy("id", "n").agg(F.count("*").alias("m")).where(F.col("m") >= _least(F.col("n"), num, den, SHARED_LATE)).select("id")
    index = stored(shared.join(able, "id", "left_semi"), "ngram-index")
    drop(shared)
    return index


def _with_leaders(index: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a leader, b) that share enough entries of lists that ``a`` leads."""
    leads = index.groupBy("gram", "sizes").agg(
        F.min(F.struct("id", "n", "pos")).alias("low"), F.max(F.struct("id", "n", "pos")).alias("high"), F.count("*").alias("m"),
    ).where("m > 1")
    ends = leads.select("gram", "sizes", F.explode(F.array_distinct(F.array("low", "high"))).alias("x"))
    met = index.withColumn("y", F.struct("id", "n", "pos")).select("gram", "sizes", "y").join(ends, ["gram", "sizes"])
    met = met.where((F.col("x.id") != F.col("y.id")) & _reaches("x", "y", num, den))
    return _enough(met, num, den)


def _enough(met: DataFrame, num: int, den: int) -> DataFrame:
    """Entry pairs (x, y) -> distinct (a, b), a < b, with as many shared entries as links have."""
    x = F.col("x.id") < F.col("y.id")
    pairs = met.select(
        "gram", F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"),
        F.when(x, F.col("x.n")).otherwise(F.col("y.n")).alias("na"), F.when(x, F.col("y.n")).otherwise(F.col("x.n")).alias("nb"),
    )
    counted = pairs.groupBy("a", "b", "na", "nb").agg(F.count_distinct("gram").alias("m"))
    return counted.where(F.col("m") >= F.least(F.lit(SHARED_LATE), _needed(F.col("na"), F.col("nb"), num, den))).select("a", "b")


def _differences(named: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(c, gram, plus, id, n, nc, component, minus, size, pos): the first differences of each set from its leader ``c``.

    Differences that no other set of the leader has are left out, but keep their position.
    """
    own = texts.join(named.select("id", "c", "n", "component").distinct(), "id")
    both = own.join(texts.select(F.col("id").alias("c"), F.col("packed").alias("led")), "c").select("c", "id", "n", "component", "packed", "led")
    apart = _map_sets(both, width, lambda x, led: (
        len(led), np.setdiff1d(x, led, assume_unique=True).view(np.int64), np.setdiff1d(led, x, assume_unique=True).view(np.int64),
    ), "nc bigint, more array<bigint>, less array<bigint>")
    apart = apart.withColumn("minus", F.size("less").cast("long")).withColumn("size", F.size("more") + F.col("minus"))
    marked = F.concat(
        F.transform("more", lambda g: F.struct(g.alias("gram"), F.lit(True).alias("plus"))),
        F.transform("less", lambda g: F.struct(g.alias("gram"), F.lit(False).alias("plus"))),
    )
    rows = stored(apart.select("c", "id", "n", "component", "nc", "minus", "size", F.inline(marked)), "ngram-differences")
    held = rows.groupBy("c", "gram", "plus").agg(F.count("*").alias("m"))
    placed = rows.join(held, ["c", "gram", "plus"]).withColumn(
        "pos", F.row_number().over(Window.partitionBy("id").orderBy("m", "plus", "gram")))
    most = F.floor(F.col("n") * F.lit(den - num) / F.lit(num)) + 1  # linked sets differ in fewer
    first = stored(placed.where((F.col("pos") <= most) & (F.col("m") > 1)).drop("m"), "ngram-apart")
    drop(rows)
    return first


def _one_leader(differences: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of one leader and different components that may have as many common differences as links need.

    Where both sets are linked to the leader, no look is needed; so one of the two is not.  With sizes d <= e of the differences, a link then needs
    d * num / (num + den) common ones or more, and d - n * (den - num) / (2 * num): so many of the smaller side suffice.
    """
    fewest = F.greatest(F.ceil(F.col("size") * num / F.lit(num + den)), F.ceil(F.col("size") - F.col("n") * (den - num) / F.lit(2 * num)), F.lit(1))
    entry = F.struct("id", "n", "component", "minus", "size", "pos")
    small = differences.where(F.col("pos") <= F.col("size") - fewest + 1).select("c", "gram", "plus", "nc", entry.alias("x"))
    large = differences.select("c", "gram", "plus", entry.alias("y"))
    needed = _needed(F.col("x.n"), F.col("y.n"), num, den) - F.col("nc") + F.col("x.minus") + F.col("y.minus")
    met = small.join(large, ["c", "gram", "plus"]).where(
        (F.struct("x.size", "x.id") < F.struct("y.size", "y.id")) & (F.col("x.component") != F.col("y.component"))
        & (F.col("x.pos") <= F.col("x.size") - needed + 1) & (F.col("y.pos") <= F.col("y.size") - needed + 1)
        & (F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num)
    )
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _across(index: DataFrame, labels: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components that share a list and are not excluded."""
    named = index.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_lists = named.groupBy("gram").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("gram")
    named = named.join(open_lists, "gram", "left_semi")
    # The leader that most of a set's lists name, of about its size.
    lead = named.groupBy("gram", "sizes").agg(F.min("id").alias("c"))
    lead = lead.select("gram", F.explode(F.array(*[F.col("sizes") + k for k in (-1, 0, 1)])).alias("sizes"), "c").groupBy("gram", "sizes").agg(F.min("c").alias("c"))
    votes = named.select("id", "gram", "sizes").join(lead, ["gram", "sizes"]).groupBy("id", "c").agg(F.count("*").alias("votes"))
    leader = votes.groupBy("id").agg(F.min_by("c", F.struct(-F.col("votes"), "c")).alias("c"))
    named = stored(named.join(leader, "id").withColumn("place", F.floor(F.log2("pos")).cast("int")), "ngram-open")
    alike = _one_leader(_differences(named, texts, width, num, den), num, den)

    blocks = named.groupBy("gram", "sizes", "place").agg(
        F.min("n").alias("n"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.max("pos").alias("pos"),
        F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("c").alias("l1"), F.max("c").alias("l2"),
    )
    p, q = blocks.alias("p"), blocks.alias("q")
    met = p.join(q, "gram").where(
        (F.struct("p.sizes", "p.place") <= F.struct("q.sizes", "q.place")) & (F.col("q.sizes") - F.col("p.sizes") <= 2)
        & ((F.col("p.c1") != F.col("q.c2")) | (F.col("p.c2") != F.col("q.c1")))
        & ((F.col("p.l1") != F.col("q.l2")) | (F.col("p.l2") != F.col("q.l1")))
        & (F.least("p.pos", "q.pos") + F.least("p.rest", "q.rest") >= _needed(F.col("p.n"), F.col("q.n"), num, den))
    ).select("gram", F.col("p.sizes").alias("s1"), F.col("p.place").alias("p1"), F.col("q.sizes").alias("s2"), F.col("q.place").alias("p2"))
    entry = F.struct("id", "n", "pos", "component", "c")
    left = named.select("gram", F.col("sizes").alias("s1"), F.col("place").alias("p1"), entry.alias("x"))
    right = named.select("gram", F.col("sizes").alias("s2"), F.col("place").alias("p2"), entry.alias("y"))
    same = (F.col("s1") == F.col("s2")) & (F.col("p1") == F.col("p2"))
    pairs = left.join(met, ["gram", "s1", "p1"]).join(right, ["gram", "s2", "p2"]).where(
        (F.col("x.component") != F.col("y.component")) & (F.col("x.c") != F.col("y.c"))
        & (~same | (F.col("x.id") < F.col("y.id"))) & _reaches("x", "y", num, den)
    )
    # Each set with its leader, so that sets which are both linked to it need no look at each other.
    led = named.where("id <> c").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"))
    return alike.union(led).union(_enough(pairs, num, den)).distinct()


def jaccard_join(
    documents: DataFrame, width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per given row: (key, n_shingles, component_id), sets of ``width`` words linked from ``num / den`` on.

    ``component_id`` is the smallest key reachable by links, the row's own key without any.  Null and empty texts
    and texts of white space have an empty set and link with nothing.  Texts with fewer words are one
    n-gram.  Rows with a null key get null as component and link with nothing.  Rows that repeat are all
    returned; keys are taken to tell texts apart.  Other columns are ignored, an empty table gives no rows.
    """
    given = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body"))
    sketches = stored(_sketches(given, width, num, den), "ngram-sketches")

    # Equal sets are one class, known by its smallest id.
    rows = stored(sketches.select("id", "set_key", "n"), "ngram-rows")  # what outlives the prefixes
    classes = rows.where("n > 0 AND id IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("id"))
    leaders = sketches.select("id", "set_key", "n", "prefix").join(classes, ["id", "set_key"])
    if documents.select(key).where(F.col(f"`{key}`").isNotNull()).groupBy(key).count().where("count > 1").limit(1).count():
        leaders = leaders.dropDuplicates(["id", "set_key"])  # rows that repeat
    entries = stored(_lists(leaders), "ngram-lists")
    total = sketches.select(F.sum(F.size("prefix").cast("long"))).first()[0] or 0
    drop(sketches)

    # Grams of long lists; their number is bounded by construction, whatever the data.
    limit = max(LONG, -(-total // FREQUENT))
    pairs = _in_short_lists(entries, limit, num, den)

    # Sets with so many long-list n-grams that a link between two of them may show in no short list.
    full = entries.where(F.col("m") > limit).groupBy("id", "n").agg(F.count("*").alias("h"))
    full = stored(full.where(F.col("h") >= _least(F.col("n"), num, den, SHARED)).select("id"), "ngram-full")
    grams = entries.where(F.col("m") > limit).select("gram").distinct().toPandas()["gram"].to_numpy(dtype=np.int64)
    drop(entries)
    frequent = np.sort(grams.view(np.uint64))
    late = _late_prefixes(given, full, width, num, den, frequent)
    late = late.join(classes.join(full, "id", "left_semi"), ["id", "set_key"]).dropDuplicates(["id", "set_key"])
    index = _index(late, num, den)

    led_pairs = stored(_with_leaders(index, num, den), "ngram-led-pairs")
    members = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(index.select("id")).distinct()
    texts = stored(_packed(given, members), "ngram-texts")

    need = _needed(F.col("na"), F.col("nb"), num, den)
    # One partner per set first; the pairs left over inside its component need no look.
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(led_pairs).distinct()
    known = stored(_verify(first, texts, width), "ngram-known")
    labels = stored(components(known.where(F.col("overlap") >= need).select(F.col("a").alias("u"), F.col("b").alias("v"))), "ngram-labels")
    of = lambda side: labels.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    rest = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    across = stored(_across(index, labels, texts, width, num, den), "ngram-across")
    rest = rest.select("a", "b").union(across).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
    checked = _verify(rest, texts, width).where(F.col("overlap") >= need)
    more = checked.select(F.col("a").alias("u"), F.col("b").alias("v"))
    # Components of the first round stand for their members.
    lifted = more.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    upper = components(lifted)
    drop(texts)
    upper = upper.select(F.col("id").alias("component"), F.col("component").alias("top"))
    tops = labels.join(upper, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    alone = upper.select(F.col("component").alias("id"), F.col("top").alias("component")).join(labels.select("id"), "id", "left_anti")
    final = tops.unionByName(alone)

    by_class = classes.join(final, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    # A class may be named by an id that is larger than its component's smallest one, never smaller.
    return rows.join(by_class, "set_key", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id")).alias("component_id"),
    )
