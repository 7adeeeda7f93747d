"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwitness.plans.durable import discard, fresh_folder

WORDS = r"[^\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Ship functions of a module inside the job, so that workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def private(*names: str) -> list[str]:
    """Column names that no given table can hold."""
    mark = uuid.uuid4().hex[:8]
    return [f"_{n}_{mark}" for n in names]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(folder).rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            discard(df.sparkSession, folder)


def held_out(doc_id: Column) -> Column:
    """True for the fold from which no label is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, label) of at most ``bound`` labelled rows outside the held-out fold, smallest hash first.

    Ids with contradicting labels are left out.  The ids are bounded, so they may be broadcast.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_other"))
        .where(F.col("label") == F.col("_other")).select("doc_id", "label")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")


def kept(name: str, make):
    """What a worker remembers beyond its task, until a task of another kind lets go of it."""
    held = sys.modules.setdefault("_kept_by_worker", {})
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


def let_go() -> None:
    """Frees what earlier tasks of this worker kept: an executor's memory serves the running stage alone."""
    sys.modules.pop("_kept_by_worker", None)


def slices(batches, rows: int = 512):
    """Arrow batches in smaller parts, so that a task's Python objects stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_texts(df: DataFrame, text: str, keep: list[str], compute, fields: str, within=None) -> DataFrame:
    """(keep, computed columns) of every row, in Arrow batches; ``keep`` columns pass untouched.

    ``compute`` maps a list of texts (null as empty) to one list per field.  With ``within``, a pair of a long column and a function
    from its values to booleans, only the rows it says yes to: in the same pass, as a second one would hold a second worker per core.
    """
    given = df.select(
        *[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text_in"), *([within[0].alias("_within")] if within else []))
    accept = within and within[1]
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        import pyarrow as pa

        let_go()
        for batch in slices(batches):
            if accept:
                batch = batch.filter(pa.array(accept(batch.column(len(keep) + 1).to_numpy()).astype(bool)))
                if not batch.num_rows:
                    continue
            columns = compute(batch.column(len(keep)).to_pylist())
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:len(keep)]]
    return given.mapInArrow(run, ", ".join([*kept, fields]))


def filter_texts(df: DataFrame, text: str, accept) -> DataFrame:
    """The rows whose text ``accept`` says yes to (a list of booleans for a list of texts), all columns untouched."""
    at = df.columns.index(text)

    def run(batches):
        import pyarrow as pa

        let_go()
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(accept(texts), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)
