"""Filter interaction audit by decision diagrams.

Every document fails some of the filters; which ones is its failure mask. Spark
counts the masks of every part, at most 2**filters of them each. A part's counts
become a decision diagram: one level per filter, a node decides whether its
filter fails, and weighs as much as the documents below it; equal subdiagrams of
a level are one node. A walk from the root along "passes" shows what each filter
of the diagram's order removes. All orders are reached by swapping two adjacent
levels at a time, which rebuilds only the nodes of these two levels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import utf8

#: All orders of the filters are listed, so their number is bounded: 7 give 5,040 orders a part.
MOST_FILTERS = 7
#: What is counted of a document: itself, its good label, its toxic label.
Counts = tuple[int, int, int]
_NONE: Counts = (0, 0, 0)


def _plus(a: Counts, b: Counts) -> Counts:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


class MaskDiagram:
    """A count-weighted decision diagram of failure masks (bit i set: filter i fails)."""

    def __init__(self, masks: dict[int, Counts], filters: int) -> None:
        self.order = list(range(filters))
        # Per level: (passes, fails) -> node. A node is (passes, fails, weight); a leaf is its counts.
        self._unique: list[dict] = [{} for _ in range(filters)]
        below = [masks.get(m, _NONE) for m in range(1 << filters)]
        for level in reversed(range(filters)):
            half = 1 << level
            below = [self._node(level, below[m], below[m + half]) for m in range(half)]
        self.root = below[0]

    @staticmethod
    def weight(node) -> Counts:
        return node[2] if len(node) == 3 and isinstance(node[2], tuple) else node

    def _node(self, level: int, passes, fails):
        key = (id(passes), id(fails)) if level + 1 < len(self._unique) else (passes, fails)
        found = self._unique[level].get(key)
        if found is None:
            found = (passes, fails, _plus(self.weight(passes), self.weight(fails)))
            self._unique[level][key] = found
        return found

    def nodes(self) -> list[int]:
        """How many nodes each level holds."""
        return [len(level) for level in self._unique]

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the next; nodes above keep their functions, those below are shared."""
        upper = self._unique[level]
        self._unique[level], self._unique[level + 1] = {}, {}
        moved = {}
        for node in upper.values():
            (pp, pf, _), (fp, ff, _), _ = node
            # `pf`: the upper filter passes, the lower one fails.
            moved[id(node)] = self._node(level, self._node(level + 1, pp, fp), self._node(level + 1, pf, ff))
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        for above in reversed(range(level)):
            nodes, self._unique[above] = self._unique[above], {}
            changed = {}
            for node in nodes.values():
                changed[id(node)] = self._node(above, moved[id(node[0])], moved[id(node[1])])
            moved = changed
        self.root = moved[id(self.root)]

    def steps(self) -> list[tuple[int, Counts, Counts, int]]:
        """Along the all-pass path: (filter, kept, removed, how many fail this filter alone)."""
        found, node = [], self.root
        for level, name in enumerate(self.order):
            passes, fails, _ = node
            alone = fails
            for _ in self.order[level + 1 :]:
                alone = alone[0]
            found.append((name, self.weight(passes), self.weight(fails), self.weight(alone)[0]))
            node = passes
        return found


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap, one after the other, to pass through all orders of n filters once."""
    if n < 2:
        return
    # The last filter walks through every order of the others, to and fro.
    inner, down = adjacent_swaps(n - 1), True
    for _ in range(factorial(n - 1)):
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        following = next(inner, None)
        if following is not None:
            # It stands in front of the others after a way down, behind them after a way up.
            yield following + 1 if down else following
        down = not down


def audit_part(masks: dict[int, Counts], names: Sequence[str]) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step."""
    diagram = MaskDiagram(masks, len(names))
    walks, total, share = [], {}, dict.fromkeys(range(len(names)), 0)
    for swap in (None, *adjacent_swaps(len(names))):
        if swap is not None:
            diagram.swap(swap)
        walk = diagram.steps()
        total.setdefault(walk[0][0], walk[0][2][0])  # at the top a filter removes all that fail it
        for name, _, removed, _ in walk:
            share[name] += removed[0]
        walks.append(walk)
    for walk in walks:
        order = "".join(names[name] for name, *_ in walk)
        for step, (name, kept, removed, alone) in enumerate(walk, 1):
            yield order, step, kept[0], removed[0], total[name] - removed[0], alone, removed[1], removed[2], share[name]


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text; null counts as empty.

    A: under 200 words. B: distinct words under half of all. C: capitals A-Z
    over 2 % of the characters. D: a symbol of `#$%&*|`.
    """
    whole = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    capitals = F.octet_length(F.regexp_replace(whole, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 50,
        "C": capitals.cast("long") * 100 > F.length(whole).cast("long") * 2,
        "D": whole.rlike(r"[#$%&*|]"),
    }


def failure_masks(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, Column],
    copies: str | None = "E",
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """(part, mask, n, good, toxic): documents by failure mask, bit i for the i-th filter, `copies` last.

    A document fails `copies` if a smaller id has an equal text, compared by
    SHA-256. Nothing is grouped as rows: equal rows, then the rows of equal text,
    part and labels, are counted before they meet, so a text that fills a third
    of the table costs a few rows per part and task.
    """
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters.values())), F.lit(0))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(utf8(F.col(f"`{text_col}`")), 256)).alias("same"),
        mask.cast("int").alias("mask"),
    )
    rows = rows.groupBy("doc_id", "part", "same", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = (
        labels.select(
            F.col("doc_id").alias("of"),
            F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
            F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
        )
        .where("of is not null")
        .groupBy("of")
        .agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    )
    # Rows without an id have no label; the text's hash spreads them over the tasks.
    place = F.when(F.col("doc_id").isNull(), F.hash("same")).otherwise(F.hash("doc_id"))
    rows = rows.withColumn("place", place)
    marks = marks.withColumn("at", F.hash("of"))
    marked = rows.join(marks, (F.col("place") == F.col("at")) & (F.col("doc_id") == F.col("of")), "left").select(
        "part", "same", "mask", "doc_id", "n",
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    if copies is None:
        counted = marked.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    else:
        named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
        alike = marked.groupBy("part", "same", "mask", "good", "toxic").agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("with_id"),
            F.min(named).alias("first"),
        )
        least = alike.groupBy("same").agg(F.min("first.doc_id").alias("least"))
        both = alike.join(least.withColumnRenamed("same", "text"), F.col("same") == F.col("text"))
        fails = F.col("with_id") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
        split = F.array(
            F.struct(F.col("mask"), (F.col("n") - fails).alias("n")),
            F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(filters))).alias("mask"), fails.alias("n")),
        )
        counted = both.select("part", "good", "toxic", F.inline(split))
    return counted.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(F.lit(0))).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(F.lit(0))).alias("toxic"),
    )


def filter_audit(masks: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step, from the counts that `failure_masks` gives.

    Columns: part, filter_order (the names in order), step (from 1), kept after the
    step, removed at it, redundant (failing this filter but removed before), unique_fails
    (failing this filter alone), good_lost and toxic_lost (labelled ones among the removed),
    shapley (removed by this filter, summed over all orders). A part without any
    documents does not appear; an empty table gives an empty result. A part holds
    2**filters counts at most, whatever its size, and parts never meet in one task's memory.
    """
    names = list(names)
    if not 1 <= len(names) <= MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"Give 1 to {MOST_FILTERS} filters with names of their own.")
    schema = (
        "part string, filter_order string, step int, kept long, removed long, redundant long,"
        " unique_fails long, good_lost long, toxic_lost long, shapley long"
    )
    fields = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]

    def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in counts}
                rows = [(part, *row) for row in audit_part(held, names)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], fields)

    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    return parts.mapInArrow(audited, schema)
