"""Suffix order of many sequences by the difference cover modulo 3, as Spark joins and sorts.

The suffixes at places 1 and 2 modulo 3 are sampled. Their triples of symbols
are sorted and named, and the names make shorter sequences whose suffix order
is found the same way. The remaining suffixes, at places 0 modulo 3, follow
from their first symbol and the rank of the next place, and are merged with
the sampled ones by two sorts: against place 1 by (symbol, next rank), against
place 2 by (symbol, symbol, next rank).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tablewash.llm.common import discard, stored, written


def counted(frame: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """The rows sorted by `keys`; before_<flag> says how many rows with that flag (0 or 1) come earlier.

    Each task counts within its key range; one row of sums a task comes to the driver.
    """
    at = [frame.columns.index(f) for f in flags]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = np.zeros(len(flags), np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            columns = []
            for k, i in enumerate(at):
                own = batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
                columns.append(pa.array(np.cumsum(own) - own + done[k]))
                done[k] += own.sum()
            place = pa.array(np.full(batch.num_rows, part, np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, place, *columns], [*batch.schema.names, "_part", *(f"_b_{f}" for f in flags)]
            )

    more = [StructField("_part", IntegerType()), *(StructField(f"_b_{f}", LongType()) for f in flags)]
    schema = StructType([*frame.schema.fields, *more])
    done = stored(frame.orderBy(*keys).mapInArrow(numbered, schema), "sorted")
    ends = done.groupBy("_part").agg(*(F.max(F.col(f"_b_{f}") + F.col(f)).alias(f) for f in flags)).collect()
    total, starts = [0] * len(flags), []
    for row in sorted(ends, key=lambda r: r["_part"]):
        starts.append((row["_part"], *total))
        total = [t + row[f] for t, f in zip(total, flags, strict=True)]
    names = ", ".join(["_of int", *(f"_s_{f} long" for f in flags)])
    offsets = frame.sparkSession.createDataFrame(starts, names)
    joined = done.join(F.broadcast(offsets), F.col("_part") == F.col("_of"))
    return joined.select(*frame.columns, *((F.col(f"_b_{f}") + F.col(f"_s_{f}")).alias(f"before_{f}") for f in flags))


def suffix_order(text: DataFrame, depth: int) -> DataFrame:
    """(seq, pos, rank) of every suffix of `text` (seq, pos, sym, size: all long), ranks from 0 without gaps.

    pos counts from 0 without gaps in each sequence, sym is not negative, size
    is what the symbol stands for. Ranks put suffixes in the order of their
    symbols as far as `depth` in sizes reaches; a suffix that is the beginning
    of another comes first. Suffixes alike to that depth, or to both their
    ends, have neighbouring ranks in some order.
    """
    since = written()
    merged = _ranks(text, depth).withColumn("one", F.lit(1))
    order = counted(merged, ["rank", "seq", "pos"], ["one"]).select("seq", "pos", F.col("before_one").alias("rank"))
    order = stored(order, "order")
    discard(text.sparkSession, since, order)
    return order


def _ranks(text: DataFrame, depth: int) -> DataFrame:
    """How many suffixes come before each; suffixes that stay alike may share a rank."""
    along = Window.partitionBy("seq").orderBy("pos")
    nexts = [F.lead("sym", k, -1).over(along).alias(f"s{k}") for k in (1, 2)]
    reach = F.col("size") + sum((F.lead("size", k, 0).over(along) for k in (1, 2)), F.lit(0))
    t = stored(text.select("seq", "pos", "sym", *nexts, reach.alias("reach")), "triples")
    sample = t.filter("pos % 3 <> 0")
    kinds = sample.groupBy("sym", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("least"))
    names = stored(kinds.orderBy("sym", "s1", "s2").withColumn("name", F.monotonically_increasing_id()), "names")
    given = names.select(F.col("sym").alias("y0"), F.col("s1").alias("y1"), F.col("s2").alias("y2"), "name")
    named = sample.join(given, (F.col("sym") == F.col("y0")) & (F.col("s1") == F.col("y1")) & (F.col("s2") == F.col("y2")))
    named = named.select("seq", "pos", "name", "reach")
    if names.filter((F.col("n") > 1) & (F.col("least") < depth) & (F.col("s2") >= 0)).limit(1).count():
        shorter = named.select(
            (F.col("seq") * 2 + (F.col("pos") % 3 - 1)).alias("seq"),
            F.floor(F.col("pos") / 3).cast("long").alias("pos"),
            F.col("name").alias("sym"),
            F.col("reach").alias("size"),
        )
        below = _ranks(shorter, depth)
        part = F.pmod("seq", F.lit(2))
        ranks = below.select(
            F.shiftright("seq", 1).alias("seq"), (F.col("pos") * 3 + 1 + part).alias("pos"), "rank"
        )
    else:
        ordered = counted(named.withColumn("one", F.lit(1)), ["name", "seq", "pos"], ["one"])
        ranks = ordered.select("seq", "pos", F.col("before_one").alias("rank"))
    # Ranks at this place and the next two, all in one row.
    rows = t.join(ranks.select(F.col("seq").alias("q"), F.col("pos").alias("p"), "rank"), (F.col("seq") == F.col("q")) & (F.col("pos") == F.col("p")), "left")
    ahead = [F.coalesce(F.lead("rank", k).over(along), F.lit(-1)).alias(f"r{k}") for k in (1, 2)]
    rows = stored(rows.select("seq", "pos", "sym", "s1", "rank", *ahead), "ahead")
    third = (F.col("pos") % 3).alias("third")
    flags = [(F.col("third") == 0).cast("int").alias("rest"), (F.col("third") != 0).cast("int").alias("sampled")]
    first = rows.filter("pos % 3 <> 2").select("seq", "pos", "rank", third, "sym", "r1").select("*", *flags)
    second = rows.filter("pos % 3 <> 1").select("seq", "pos", "rank", third, "sym", "s1", "r2").select("*", *flags)
    ones = counted(first, ["sym", "r1", "third", "seq", "pos"], ["rest", "sampled"])
    twos = counted(second, ["sym", "s1", "r2", "third", "seq", "pos"], ["rest", "sampled"])
    # A remaining suffix counts what is before it in both sorts, a sampled one its own rank and the remaining ones.
    rest = (
        ones.filter("third = 0")
        .select("seq", "pos", (F.col("before_rest") + F.col("before_sampled")).alias("rank"))
        .union(twos.filter("third = 0").select("seq", "pos", F.col("before_sampled").alias("rank")))
        .groupBy("seq", "pos")
        .agg(F.sum("rank").alias("rank"))
    )
    other = [
        c.filter(f"third = {k}").select("seq", "pos", (F.col("rank") + F.col("before_rest")).alias("rank"))
        for k, c in ((1, ones), (2, twos))
    ]
    return rest.union(other[0]).union(other[1])
