"""Helpers of the training-data operators: the shared folder, stored tables, exact selection."""

from __future__ import annotations

import atexit
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tablewash-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where the setting is absent, a local session gets a folder of its own; any
    other session must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
    spark.sparkContext.setCheckpointDir(_own_folder())
    return _own_folder()


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/tablewash-{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    found = spark.read.schema(frame.schema).parquet(path)
    found.__dict__["stored_at"] = path
    _written.append(path)
    return found


#: Paths of stored tables that nothing has discarded yet, in the order they were written.
_written: list[str] = []


def written() -> int:
    return len(_written)


def discard(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Delete the tables stored since `written()` gave `since`, but those kept, and let go of finished shuffles.

    Only for tables whose readers are themselves stored: nothing may need them again.
    """
    keep = {f.__dict__["stored_at"] for f in kept}
    gone = [p for p in _written[since:] if p not in keep]
    _written[since:] = [p for p in _written[since:] if p in keep]
    jvm = getattr(spark.sparkContext, "_jvm", None)
    for path in gone if jvm is not None else ():
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    release(spark)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that differ from all columns of a table, whatever the case of their letters."""
    taken = {c.lower() for c in columns}
    found = []
    for name in wanted:
        while name in taken:
            name += "_"
        taken.add(name)
        found.append(name)
    return found


def quoted(name: str) -> Column:
    """A column by its name alone, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(frame: DataFrame, function: Callable, schema: StructType | str) -> DataFrame:
    """`mapInArrow` over all columns, whatever their names: Spark takes a dot in a name for a field."""
    names = frame.columns

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(batch.rename_columns(names) for batch in batches)

    return frame.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(renamed, schema)


def checkpointed(frame: DataFrame) -> DataFrame:
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def utf8(text: Column) -> Column:
    """The text's bytes; null counts as empty."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def nth_smallest(frame: DataFrame, key: str, n: int, bits: int = 12) -> tuple[int, int] | None:
    """Exact selection over a long column: the n-th smallest value (n from 1) and how many are below it.

    Each pass counts the rows under every value of the next `bits` bits within
    the one range that holds the answer, so a pass returns at most 2**bits
    counts to the driver, whatever the table. None if there are fewer rows.
    """
    shift, prefix, below = 64, None, 0
    while shift > 0:
        step = min(bits, shift)
        part = frame if prefix is None else frame.filter(F.shiftright(key, shift) == prefix)
        counts = sorted(
            part.groupBy(F.shiftright(key, shift - step).alias("p")).count().collect(),
            key=lambda row: row["p"],
        )
        for row in counts:
            if below + row["count"] >= n:
                prefix = row["p"]
                break
            below += row["count"]
        else:
            return None
        shift -= step
    return prefix, below


def map_texts(
    docs: DataFrame,
    function: Callable[[pa.Array, list[bytes]], pa.RecordBatch],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Apply a function to (ids, texts as UTF-8 bytes) of each Arrow batch; null texts count as empty."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            yield function(batch.column(0), batch.column(1).to_pylist())

    return docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text")).mapInArrow(mapped, schema)


def hash_sample(frame: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """At most n distinct ids, those with the smallest seeded hash: the same ones whatever the partitions."""
    ids = frame.select(F.col(id_col).alias("doc_id")).filter(F.col(id_col).isNotNull()).distinct()
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def release(spark: SparkSession) -> None:
    """Let go of finished steps: Spark deletes shuffle files once the driver's JVM has collected their plans."""
    gc.collect()
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def slices(batches: Iterable[pa.RecordBatch], column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a binary column holds `limit` bytes at most, or one row: what a task holds stays bounded."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if batch.num_rows > start or not batch.num_rows:
            yield batch.slice(start)
