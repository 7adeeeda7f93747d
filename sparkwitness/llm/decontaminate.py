"""Benchmark decontamination under edit distance.

Texts are sequences of lower-cased words without punctuation.  An item of m words is found in a document where a
stretch is within ``share * m`` word edits of it.  At least ``RUN`` words of such a stretch stand unedited in a row, so
windows of item size are laid at every document position that shares a run with an item; nothing is lost by that.  The CGK
embedding walks a window and an item with common random steps: an edit puts the walks out of step only for
a while, and edit distance becomes Hamming distance.  Bit sampling compares a few sampled positions of the walks in
each of many tables, enough for ``recall``; pairs that agree in a table are verified by exact edit distance.

Items are given in blocks of bounded size and sent to all tasks; documents are read once per block.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, slices, words_of
from .tokens import to_arrow_schema

by_value(__name__)

WORD = re.compile(r"\w+")
SHARE = 0.2
#: Items with fewer words are evidence of nothing and are not searched.
LEAST = 8
#: Words of items sent to tasks at once.
BOUND = 1 << 20
#: Independent walks, tables and sampled positions per walk, steps per word.
WALKS, TABLES, SAMPLED, STRETCH = 3, 32, 2, 2


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def words(text: str, known: WordHashes) -> np.ndarray:
    found = WORD.findall(text.lower())
    if len(known) > 150_000:
        known.clear()
    return np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def runs(h: np.ndarray, run: int) -> np.ndarray:
    """Hashes of all runs of ``run`` words."""
    n = max(len(h) - run + 1, 0)
    out = np.full(n, run, dtype=np.uint64)
    for k in range(run):
        out = _mix(out ^ h[k:k + n])
    return out


def run_length(m: int, share: float) -> int:
    """Words in a row that survive ``floor(share * m)`` edits of m words, at least."""
    k = int(share * m)
    return -(-(m - k) // (k + 1))


def walk(rows: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK walks of equally long rows of hashes: at each step write the word, then stay or move by a common random bit.

    The bit depends on the step and the word only; past the end a walk writes 0.
    """
    n, m = rows.shape
    padded = np.concatenate([rows, np.zeros((n, 1), dtype=np.uint64)], axis=1)
    at, out, each = np.zeros(n, dtype=np.int64), np.zeros((n, steps), dtype=np.uint64), np.arange(n)
    for j in range(steps):
        word = padded[each, np.minimum(at, m)]
        out[:, j] = word
        at += (_mix(word ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 + seed & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)).astype(np.int64)
    return out


def samples(rows: np.ndarray) -> np.ndarray:
    """One hash per table of sampled positions, for each of several walks over equally long rows.

    One walk that an early edit puts out of step may stay so; independent ones seldom all do.
    """
    m = rows.shape[1]
    draw = np.random.default_rng(m)
    out = np.zeros((len(rows), WALKS * TABLES), dtype=np.uint64)
    for w in range(WALKS):
        walked = walk(rows, STRETCH * m, 7 + w)
        for t in range(w * TABLES, (w + 1) * TABLES):
            h = np.full(len(rows), t, dtype=np.uint64)
            for p in draw.integers(0, walked.shape[1], SAMPLED):
                h = _mix(h ^ walked[:, p])
            out[:, t] = h
    return out


def closest(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(edits, end): the least edit distance of the item to any stretch of the text, and where that ends."""
    n = len(text)
    last = np.zeros(n + 1, dtype=np.int64)  # a stretch may start anywhere
    ramp = np.arange(n + 1)
    for i, word in enumerate(item, 1):
        row = np.empty(n + 1, dtype=np.int64)
        row[0] = i
        row[1:] = np.minimum(last[1:] + 1, last[:-1] + (text != word))
        last = np.minimum.accumulate(row - ramp) + ramp  # insertions along the row
    end = int(last.argmin())
    return int(last[end]), end


class Items:
    """A bounded block of items, with their run index and sampled walks."""

    def __init__(self, rows: list[tuple[int, str]], share: float, least: int):
        known = WordHashes()
        self.share = share
        self.items = [(i, w) for i, w in ((i, words(t or "", known)) for i, t in rows) if len(w) >= least]
        self.length = np.array([len(w) for _, w in self.items], dtype=np.int64)
        self.index = {}
        for run in sorted({run_length(len(w), share) for _, w in self.items}):
            own = [j for j, (_, w) in enumerate(self.items) if run_length(len(w), share) == run]
            grams = [runs(self.items[j][1], run) for j in own]
            gram = np.concatenate(grams)
            sort = np.argsort(gram, kind="stable")
            seen = np.zeros(1 << 16, dtype=bool)
            seen[(gram >> np.uint64(48)).astype(np.int64)] = True
            self.index[run] = (
                gram[sort], np.repeat(np.array(own), [len(g) for g in grams])[sort], np.concatenate([np.arange(len(g)) for g in grams])[sort], seen)
        self.tables = [samples(w[None, :])[0] for _, w in self.items]

    def windows(self, h: np.ndarray) -> np.ndarray:
        """Rows (item, start) of every item-sized window that shares a run with its item, aligned by the run."""
        out = [np.zeros((0, 2), dtype=np.int64)]
        for run, (gram, owner, offset, seen) in self.index.items():
            g = runs(h, run)
            hit = np.flatnonzero(seen[(g >> np.uint64(48)).astype(np.int64)])
            if not len(hit):
                continue
            low, high = np.searchsorted(gram, g[hit], "left"), np.searchsorted(gram, g[hit], "right")
            many = high - low
            if many.any():
                entry = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                start = np.maximum(np.repeat(hit, many) - offset[entry], 0)
                out.append(np.unique(np.stack([owner[entry], start], axis=1), axis=0))
        return np.concatenate(out)

    def hits(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """Per document (item id, first word, words, edits): the best place of every item found in it.

        Windows of all given documents are walked together, by their length.
        """
        found = [self.windows(h) for h in texts]
        doc = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        pairs = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        lengths = self.length[pairs[:, 0]] if len(pairs) else np.zeros(0, dtype=np.int64)
        for m in np.unique(lengths):
            chosen = np.flatnonzero(lengths == m)
            for lo in range(0, len(chosen), 8192):
                self._check(texts, doc, pairs, chosen[lo:lo + 8192], int(m), best)
        return [[(self.items[i][0], first, last - first, edits) for i, (edits, first, last) in sorted(b.items())] for b in best]

    def _check(self, texts, doc, pairs, chosen, m: int, best) -> None:
        rows = np.zeros((len(chosen), m), dtype=np.uint64)
        for r, c in enumerate(chosen):
            part = texts[doc[c]][pairs[c, 1]:pairs[c, 1] + m]
            rows[r, :len(part)] = part
        alike = (samples(rows) == np.stack([self.tables[i] for i in pairs[chosen, 0]])).any(axis=1)
        k = int(self.share * m)
        for c in chosen[alike]:
            (i, start), h, own = pairs[c], texts[doc[c]], best[doc[c]]
            if i in own and own[i][0] == 0:
                continue  # found unedited already
            lo, hi = max(0, int(start) - k), min(len(h), int(start) + m + k)
            if np.isin(h[lo:hi], self.items[i][1]).sum() < m - k:
                continue  # too few of its words to be within k edits
            edits, end = closest(self.items[i][1], h[lo:hi])
            if edits <= k and (i not in own or edits < own[i][0]):
                own[i] = (edits, max(lo, lo + end - m), lo + end)


def blocks_of(benchmark: DataFrame, item: str, text: str, share: float, least: int, bound: int):
    """The benchmark as blocks of about ``bound`` words each."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(words_of(F.col("t"))), F.lit(0))).first()[0]
    count = max(1, -(-int(total) // bound))
    for b in range(count):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == b) if count > 1 else rows
        yield Items([(r["i"], r["t"]) for r in part.distinct().collect()], share, least)


def find(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    share: float = SHARE, least: int = LEAST, bound: int = BOUND,
) -> DataFrame:
    """(key, item, first_word, n_words, edits): a row per document row and item found in it, at its best place.

    Null and empty texts hold nothing; null items and items below ``least`` words are not searched; an empty benchmark
    or table gives no rows.  Rows that repeat are searched alike; an item given twice is found once.  Other columns are ignored.
    """
    out = None
    key_type = documents.schema[key].dataType.simpleString()
    item_type = benchmark.schema[item].dataType.simpleString()
    ddl = f"`{key}` {key_type}, `{item}` {item_type}, first_word long, n_words long, edits int"
    schema = to_arrow_schema(ddl)
    given = documents.select(F.col(f"`{key}`"), F.col(f"`{text}`")).where(F.col(f"`{text}`").isNotNull())
    for block in blocks_of(benchmark, item, item_text, share, least, bound):
        held = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches, held=held):
            import pyarrow as pa

            known, items = WordHashes(), held.value
            for batch in slices(batches, 2048):
                found = []
                texts = [words(t, known) for t in batch.column(1).to_pylist()]
                for doc, hits in zip(batch.column(0).to_pylist(), items.hits(texts), strict=True):
                    for i, first, n, edits in hits:
                        found.append({key: doc, item: i, "first_word": first, "n_words": n, "edits": edits})
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

        part = given.mapInArrow(run, ddl)
        out = part if out is None else out.unionByName(part)
    return out


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` in which no item is found, all columns untouched."""
    item, item_text = options.pop("item", "item_id"), options.pop("item_text", "text")
    share, least, bound = options.pop("share", SHARE), options.pop("least", LEAST), options.pop("bound", BOUND)
    at = documents.columns.index(text)
    out = documents
    for block in blocks_of(benchmark, item, item_text, share, least, bound):
        held = documents.sparkSession.sparkContext.broadcast(block)

        def run(batches, held=held):
            import pyarrow as pa

            known, items = WordHashes(), held.value
            for batch in slices(batches, 2048):
                texts = [words(t or "", known) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array([not hits for hits in items.hits(texts)], type=pa.bool_()))

        out = out.mapInArrow(run, documents.schema)
    return out
