"""Token ids in a bit-plane shuffled container.

Documents are laid out in ascending id order by a range partitioning; each partition is a shard.
A shard's ids are cut into blocks of at most ``BLOCK`` ids, between documents unless one is longer; a block is transposed into its byte planes or bit
planes, each plane is compressed with zstandard, and a row per block holds the planes, the number of
ids, a checksum and the index of the documents in it.  The container is a folder of such rows
(Parquet, own compression off), so any store that Spark writes can hold it, and blocks are read alone.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema as _to_arrow
from pyspark.sql.types import StructType

from sparkwitness.plans.durable import fresh_folder

from .common import by_value, kept, slices

by_value(__name__)

#: Ids per block, and the end id.
BLOCK = 65_536
END = 1
SCHEMA = (
    "shard int, block int, n_ids int, crc long, planes array<binary>, "
    "docs array<struct<place:bigint,doc_id:bigint,at:bigint,piece:int,last:boolean,offset:int,length:int>>"
)
PIECES = "shard int, place bigint, doc_id bigint, at bigint, piece int, last boolean, ids binary"


def shuffle_planes(ids: np.ndarray, bits: bool = True) -> list[bytes]:
    """uint32 ids -> planes, lowest first; planes above the highest id are left out.

    With ``bits``: 1 plane per bit, 8 ids per byte.  Without: 1 plane per byte.
    """
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        planes = [raw[:, k] for k in range(4)]
    else:
        highest = int(ids.max()) if len(ids) else 0
        columns = [np.ascontiguousarray(raw[:, k]) for k in range((highest.bit_length() + 7) // 8)]
        planes = [np.packbits(columns[k // 8] & (1 << (k % 8)), bitorder="little") for k in range(highest.bit_length())]
    while planes and not planes[-1].any():
        planes.pop()
    return [p.tobytes() for p in planes]


def restore_planes(planes: list[bytes], n: int, bits: bool = True) -> np.ndarray:
    """The inverse of ``shuffle_planes``."""
    out = np.zeros((n, 4), dtype=np.uint8)
    for k, plane in enumerate(planes):
        part = np.frombuffer(plane, dtype=np.uint8)
        if bits:
            out[:, k // 8] |= np.unpackbits(part, count=n, bitorder="little") << (k % 8)
        else:
            out[:, k] = part
    return out.reshape(-1).view("<u4")


def to_arrow_schema(ddl: str):
    return _to_arrow(StructType.fromDDL(ddl))


#: No character of plain pieces: those up to U+024F without white space, controls and the dotted capital I, which
#: no normal form composes and which have one lower-case letter each.
NOT_PLAIN = "[^!-~\u00a1-\u012f\u0131-\u024f]"
#: The one pattern of words that ``Encoder`` knows how to cut by.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER, NUMBER, OTHER = 1, 2, 3


def _word_rule(tokenizer):
    """(pattern of its words, whether an id ends a word, added tokens), or None.

    For tokenizers that lower-case, keep the matches of ``WORD`` and mark each match's last token by a suffix.
    """
    spec = json.loads(tokenizer.to_str())
    steps = {n["type"]: n for n in (spec["normalizer"] or {}).get("normalizers", [])}
    parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    suffix = spec["model"].get("end_of_word_suffix")
    if set(steps) != {"NFC", "Replace", "Lowercase"} or [p["type"] for p in parts] != ["Split", "ByteLevel"] or not suffix:
        return None
    if steps["Replace"]["pattern"] != {"Regex": r"\s+"} or steps["Replace"]["content"] != " ":
        return None
    if parts[0]["behavior"] != "Removed" or not parts[0]["invert"] or parts[0]["pattern"] != {"Regex": WORD}:
        return None
    if parts[1]["use_regex"] or parts[1]["add_prefix_space"] or spec["post_processor"]:
        return None
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    for token, number in vocabulary.items():
        ends[number] = token.endswith(suffix)
    return regex.compile(WORD), ends, [t["content"] for t in spec["added_tokens"]]


def _kinds() -> np.ndarray:
    """The kind of each plain character in lower case, 0 for all else."""
    out = np.zeros(1 << 16, dtype=np.uint8)
    for c in map(chr, range(0x250)):
        if not re.match(NOT_PLAIN, c):
            out[ord(c.lower())] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c.lower())[0], OTHER)
    return out


class Encoder:
    """Little-endian uint32 ids of texts, by the tokenizer at the path.

    White space ends a token in this tokenizer and is dropped, so texts are encoded by their distinct pieces between spaces and
    line ends, each once per batch.  A plain piece (of such characters, without added tokens) is encoded by its distinct words, whose ends the ids
    themselves show; pieces of any other kind are encoded together and told apart by the tokens' offsets.  Texts, pieces and words stay in Arrow
    arrays; Python objects are made of distinct words alone.  Words and other pieces met before are remembered, at most ``remembered`` of either
    beside the last batch's.
    """

    def __init__(self, tokenizer_path: str, remembered: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.rule = _word_rule(self.tokenizer)
        self.kinds = _kinds()
        self.remembered = remembered
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _by_offsets(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        at = np.array([o[0] for o in found.offsets], dtype=np.int64)
        cuts = np.searchsorted(at, np.cumsum([0] + [len(p) + 1 for p in pieces])).tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _by_word_ends(self, words: list[str], at_once: int = 256) -> list[bytes]:
        groups = [words[k:k + at_once] for k in range(0, len(words), at_once)]
        out = []
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            cuts = (np.flatnonzero(self.rule[1][ids]) + 1).tolist()
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                out += self._by_offsets(group)
                continue
            raw = ids.tobytes()
            out += [raw[4 * a:4 * b] for a, b in zip([0, *cuts], cuts)]
        return out

    def _recall(self, known: dict[str, bytes], asked: list[str], encode) -> list[bytes]:
        """The ids of distinct words or pieces, from what is known where it is."""
        found = list(map(known.get, asked))
        fresh = [w for w, ids in zip(asked, found) if ids is None and w]
        new = encode(fresh) if fresh else []
        if len(known) + len(fresh) > self.remembered:
            known.clear()
        known.update(zip(fresh, new, strict=True))
        rest = iter(new)
        return [(next(rest) if w else b"") if ids is None else ids for w, ids in zip(asked, found)]

    def _spaced(self, text: str) -> str:
        """Lower-case plain pieces without apostrophes, with a space between the words of a piece."""
        codes = np.frombuffer(text.encode("utf-16-le"), dtype="<u2")
        kinds = self.kinds[codes]
        before, after = kinds[:-1], kinds[1:]
        at = np.flatnonzero((before > 0) & (after > 0) & ((before != after) | (after == NUMBER))) + 1
        return np.insert(codes, at, 32).tobytes().decode("utf-16-le")

    def _by_words(self, pieces, spaced):
        """The ids of an array of plain pieces.  ``spaced`` puts a space between the words of lower-case pieces, a piece a line."""
        import pyarrow as pa
        import pyarrow.compute as pc

        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], type=pa.int32()), pieces), "\n")[0].as_py()
        lists = pc.split_pattern(pc.split_pattern(pa.array([spaced(text.lower())]), "\n").flatten(), " ")
        words = lists.flatten().dictionary_encode()
        ids = pa.array(self._recall(self.words, words.dictionary.to_pylist(), self._by_word_ends), type=pa.large_binary()).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends), ids.buffers()[2]])

    def _of_pieces(self, pieces):
        """The ids of an array of distinct pieces."""
        import pyarrow as pa
        import pyarrow.compute as pc

        flag = lambda found: found.to_numpy(zero_copy_only=False).astype(bool)
        apart = lambda some: pa.array(self._recall(self.pieces, some.to_pylist(), self._by_offsets), type=pa.large_binary())
        if not self.rule:
            return apart(pieces)
        odd = flag(pc.match_substring_regex(pieces, NOT_PLAIN))
        for token in self.rule[2]:
            odd |= flag(pc.match_substring(pieces, token))
        quoted = flag(pc.match_substring(pieces, "'")) & ~odd  # a contraction depends on what stands before it
        with_spaces = lambda text: self.rule[0].sub(r"\g<0> ", text)
        ways = [(~odd & ~quoted, lambda some: self._by_words(some, self._spaced)), (quoted, lambda some: self._by_words(some, with_spaces)), (odd, apart)]
        parts = [(np.flatnonzero(mine), encode(pieces.filter(pa.array(mine)))) for mine, encode in ways if mine.any()]
        if len(parts) == 1:
            return parts[0][1]
        order = np.empty(len(pieces), dtype=np.int64)
        order[np.concatenate([at for at, _ in parts])] = np.arange(len(pieces))
        return pa.concat_arrays([ids for _, ids in parts]).take(pa.array(order))

    def batch(self, texts) -> list[np.ndarray]:
        """An Arrow array of texts, none null -> the ids of each."""
        import pyarrow.compute as pc

        if not len(texts):
            return []
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        pieces = lists.flatten().dictionary_encode()
        ids = self._of_pieces(pieces.dictionary).take(pieces.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset:ids.offset + len(ids) + 1]
        flat = np.frombuffer(ids.buffers()[2], dtype="<u4") if ends[-1] else np.zeros(0, dtype="<u4")
        cuts = ends[np.cumsum([0, *pc.list_value_length(lists).to_pylist()])] // 4
        return [flat[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def make_encoder(tokenizer_path: str) -> Encoder:
    """The worker's ``Encoder`` for the path: what it remembers also serves the worker's next tasks of this kind."""
    return kept(f"encoder of {tokenizer_path}", lambda: Encoder(tokenizer_path))


def write(
    documents: DataFrame, folder: str, tokenizer_path: str, key: str = "doc_id", text: str = "text",
    block: int = BLOCK, bits: bool = True, level: int = 3, partitions: int | None = None,
) -> None:
    """Encode whole texts in ascending key order and write the container.

    Null text is empty and gives the end id alone.  Null keys come first; rows that share a key
    keep the order of their texts.  An empty table writes an empty container.  Other columns are ignored.
    """
    spark = documents.sparkSession
    rows_schema = to_arrow_schema(SCHEMA)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = (
        documents.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
        .repartitionByRange(n, F.col("_key").asc_nulls_first(), F.xxhash64("_text"))
        .sortWithinPartitions(F.col("_key").asc_nulls_first(), "_text")
        .withColumn("_shard", F.spark_partition_id())
    )

    def run(batches):
        import os

        import pyarrow as pa
        import zstandard

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, press = make_encoder(tokenizer_path), zstandard.ZstdCompressor(level=level)
        held, size, number, shard, place, at = [], 0, 0, 0, 0, 0
        index: list[dict] = []

        def cut(ids: np.ndarray):
            nonlocal number, index
            row = {
                "shard": shard, "block": number, "n_ids": len(ids), "crc": zlib.crc32(ids.tobytes()),
                "planes": [press.compress(p) for p in shuffle_planes(ids, bits)], "docs": index,
            }
            number, index = number + 1, []
            return pa.RecordBatch.from_pylist([row], schema=rows_schema)

        for batch in slices(batches, 2048):
            found = encoder.batch(batch.column(1))
            for doc, ids, part in zip(batch.column(0).to_pylist(), found, batch.column(2).to_pylist(), strict=True):
                shard = part
                ids = np.append(ids, np.uint32(END))
                done, piece = 0, 0
                if size and size + len(ids) > block >= len(ids):  # blocks end between documents that fit one
                    yield cut(np.concatenate(held))
                    held, size = [], 0
                while done < len(ids):
                    take = min(block - size, len(ids) - done)
                    held.append(ids[done:done + take])
                    index.append({
                        "place": place, "doc_id": doc, "at": at, "piece": piece,
                        "last": done + take == len(ids), "offset": size, "length": take,
                    })
                    size, done, piece = size + take, done + take, piece + 1
                    if size == block:
                        yield cut(np.concatenate(held))
                        held, size = [], 0
                place, at = place + 1, at + len(ids)
        if size:
            yield cut(np.concatenate(held))

    laid.mapInArrow(run, SCHEMA).write.option("compression", "uncompressed").parquet(folder)


def read_blocks(spark: SparkSession, folder: str, bits: bool = True, cut: bool | None = None) -> DataFrame:
    """(shard, place, doc_id, at, piece, last, ids) a row per document and block it touches, checked by the blocks' sums.

    ``ids`` are little-endian uint32 bytes; ``at`` is the document's first id within its shard.  With ``cut``, only the pieces of
    documents that a block ends in, or only those of the others; blocks without any are not decoded.
    """
    blocks = spark.read.schema(SCHEMA).parquet(folder)
    if cut is not None:
        blocks = blocks.withColumn("docs", F.filter("docs", lambda d: ((d["piece"] > 0) | ~d["last"]) == cut)).where(F.size("docs") > 0)
    blocks = blocks.select("shard", "n_ids", "crc", "planes", "docs")
    pieces = to_arrow_schema(PIECES)

    def run(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for shard, n, crc, planes, docs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = restore_planes([press.decompress(p) for p in planes], n, bits)
                if zlib.crc32(ids.tobytes()) != crc:
                    raise ValueError(f"damaged block in shard {shard}")
                yield pa.RecordBatch.from_pylist([
                    {
                        "shard": shard, "place": d["place"], "doc_id": d["doc_id"], "at": d["at"], "piece": d["piece"], "last": d["last"],
                        "ids": ids[d["offset"]:d["offset"] + d["length"]].tobytes(),
                    } for d in docs
                ], schema=pieces)

    return blocks.mapInArrow(run, PIECES)


def read_documents(spark: SparkSession, folder: str, bits: bool = True) -> DataFrame:
    """(shard, place, doc_id, start, ids) a row per document; only documents that a block ends in are shuffled, at any size."""
    whole = read_blocks(spark, folder, bits, cut=False).select("shard", "place", "doc_id", "at", "ids")
    cut = (
        read_blocks(spark, folder, bits, cut=True).groupBy("shard", "place", "doc_id", "at")
        .agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("parts"))  # one document's own pieces
        .select("shard", "place", "doc_id", "at", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
    )
    blocks = spark.read.schema(SCHEMA).parquet(folder)
    sizes = blocks.groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    starts = sizes.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rows = whole.unionByName(cut)
    # Broadcast, as the planner takes the starts for as large as the container they come from and would shuffle all ids to meet them.
    return rows.join(F.broadcast(starts), rows["shard"] == starts["_shard"]).select(
        "shard", "place", "doc_id", (F.col("at") + F.col("_before")).alias("start"), "ids",
    )


def digest(documents: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Write the container, read it back: (doc_id, start, n_tokens, ids_crc32) per row of documents."""
    spark = documents.sparkSession
    folder = folder or fresh_folder(spark, "token-planes")
    write(documents, folder, tokenizer_path, **options)
    return read_documents(spark, folder, options.get("bits", True)).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
    )
