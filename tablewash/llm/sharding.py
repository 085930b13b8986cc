"""Shards of near-equal bytes by histogram sort.

The sort key of a row is (hash of its text, hash of its id, its place), so equal
texts lie next to each other and even one text that fills a third of the table
can be split. The splitters are found without moving rows: each pass counts the
exact bytes below the probes that lie in the ranges still open, until every
splitter is within the tolerance; the rows are then exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewash.llm.common import stored

#: Bytes a row counts besides its text.
ROW_BYTES = 16
#: Parts of the key, in order; each is a long.
_PARTS = ("k_text", "k_id", "k_place")
_LOWEST = -(2**63)


@dataclass(frozen=True)
class _Range:
    """Rows whose first parts equal `fixed` and whose next part has `prefix` above `shift` bits."""

    fixed: tuple[int, ...]
    shift: int
    prefix: int
    below: int  # exact bytes before the range

    def key(self) -> tuple[int, ...]:
        start = _LOWEST if self.shift == 64 else self.prefix << self.shift
        return (*self.fixed, start) + (_LOWEST,) * (len(_PARTS) - len(self.fixed) - 1)


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the key parts of every row; null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k_text"),
        F.xxhash64(F.col(id_col)).alias("k_id"),
        F.monotonically_increasing_id().alias("k_place"),
    )


def _counts(rows: DataFrame, ranges: list[_Range], bits: int) -> dict[_Range, list]:
    """Exact bytes and extremes of the probes' intervals in every open range; 2**bits rows a range at most."""
    found: dict[_Range, list] = {r: [] for r in ranges}
    kinds: dict[tuple[int, int], list[_Range]] = {}
    for r in ranges:
        kinds.setdefault((len(r.fixed), r.shift), []).append(r)
    for (depth, shift), members in kinds.items():
        part, step = _PARTS[depth], min(bits, shift)
        keys = [F.col(x) for x in _PARTS[:depth]]
        names = [f"_f{i}" for i in range(depth)]
        if shift < 64:
            keys, names = [*keys, F.shiftright(part, shift)], [*names, "_prefix"]
        chosen = rows
        if names:
            values = [(*r.fixed, r.prefix) if shift < 64 else r.fixed for r in members]
            picks = rows.sparkSession.createDataFrame(values, ", ".join(f"{n} long" for n in names))
            on = [k == picks[n] for k, n in zip(keys, names, strict=True)]
            chosen = rows.join(F.broadcast(picks), on)  # one row a splitter at most
        probe = F.shiftright(part, shift - step)
        by = {(*r.fixed, r.prefix) if shift < 64 else r.fixed: r for r in members}
        group = [*names, "_probe"]
        counted = chosen.withColumn("_probe", probe).groupBy(*group).agg(
            F.sum("size").alias("bytes"), F.min(part).alias("low"), F.max(part).alias("high")
        )
        for row in counted.collect():
            found[by[tuple(row[n] for n in names)]].append((row["low"], row["high"], row["bytes"]))
    return found


def _narrowed(r: _Range, low: int, high: int, below: int) -> _Range | None:
    """The smallest range that holds a probe interval's rows; None if no key tells them apart."""
    fixed = r.fixed
    if low == high:
        fixed = (*fixed, low)
        return _Range(fixed, 64, 0, below) if len(fixed) < len(_PARTS) else None
    shift = (low ^ high).bit_length() if (low < 0) == (high < 0) else 64
    return _Range(fixed, shift, low >> shift if shift < 64 else 0, below)


def splitters(
    rows: DataFrame, shards: int, tolerance: float = 0.001, probe_bits: int = 10
) -> list[tuple[int, ...]]:
    """Keys at which shards 1, 2, ... begin, each within tolerance * mean shard bytes of its target."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * s / shards for s in range(1, shards)]
    slack = tolerance * total / shards
    whole = _Range((), 64, 0, 0)
    open_at: dict[_Range, list[int]] = {whole: list(range(len(targets)))} if total else {}
    best: dict[int, tuple[int, ...]] = {}
    while open_at:
        counted, after = _counts(rows, list(open_at), probe_bits), {}
        for r, wanted in open_at.items():
            spans, below = [], r.below
            for low, high, size in sorted(counted[r]):
                spans.append((low, high, below, below + size))
                below += size
            for t in wanted:
                at = next(s for s in spans if s[3] >= targets[t] or s is spans[-1])
                low, high, start, end = at
                deeper = None if min(targets[t] - start, end - targets[t]) <= slack else _narrowed(r, low, high, start)
                if deeper is not None:
                    after.setdefault(deeper, []).append(t)
                elif targets[t] - start <= end - targets[t]:
                    best[t] = _key(r, low)
                else:
                    following = [s for s in spans if s[0] > low]
                    best[t] = _key(r, following[0][0]) if following else _key(r, high, 1)
        open_at = after
    return [best.get(t, (2**63 - 1,) * len(_PARTS)) for t in range(len(targets))]


def _key(r: _Range, value: int, after: int = 0) -> tuple[int, ...]:
    """The key at a value of the range's part, or the first key after it."""
    parts = (*r.fixed, value)
    if after:
        parts = list(parts)
        while parts and parts[-1] == 2**63 - 1:
            parts.pop()
        if not parts:
            return (2**63 - 1,) * len(_PARTS)
        parts[-1] += 1
    return (*parts,) + (_LOWEST,) * (len(_PARTS) - len(parts))


def _shard_of(keys: list[tuple[int, ...]], first: int = 0) -> Column:
    """How many splitters are at or below the row's key: a tree of comparisons."""
    if not keys:
        return F.lit(first)
    middle = len(keys) // 2
    reached = F.lit(True)
    for part, value in reversed(list(zip(_PARTS, keys[middle], strict=True))):
        c = F.col(part)
        reached = (c > value) | ((c == value) & reached)
    return F.when(reached, _shard_of(keys[middle + 1 :], first + middle + 1)).otherwise(_shard_of(keys[:middle], first))


def _with_slots(placed: DataFrame, bits: int) -> DataFrame:
    """The rows with ``slot``: their place within the shard in the order of the key.

    The highest `bits` bits of both hashes only deal out the work: a range of texts,
    and for one text a range of ids, is numbered by itself, from where the ranges before end.
    """
    text = F.shiftright("k_text", 64 - bits) if bits else F.lit(0).cast("long")
    ids = F.shiftright("k_id", 64 - bits) if bits else F.lit(0).cast("long")
    dealt = placed.select("*", text.alias("t"), ids.alias("i"))
    group = ["shard", "t", "k_text", "i"]
    counts = dealt.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    before = (Window.unboundedPreceding, -1)
    # A range holds few texts, and a text 2**bits ranges of ids at most.
    inside = Window.partitionBy("shard", "t").orderBy("k_text", "i").rowsBetween(*before)
    starts = counts.select(*(F.col(c).alias(f"of_{c}") for c in group), F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("within"))
    ranges = dealt.groupBy("shard", "t").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("shard").orderBy("t").rowsBetween(*before)
    first = ranges.select(F.col("shard").alias("s"), F.col("t").alias("r"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*_PARTS)) - 1
    numbered = dealt.withColumn("at", place).join(starts, [F.col(c) == F.col(f"of_{c}") for c in group])
    numbered = numbered.join(first, (F.col("shard") == F.col("s")) & (F.col("t") == F.col("r")))
    return numbered.withColumn("slot", (F.col("first") + F.col("within") + F.col("at")).cast("long"))


def histogram_shards(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 0.001,
    probe_bits: int = 10,
    rows_per_bucket: int = 50_000,
) -> DataFrame:
    """Every row with its shard and its slot in the shard, law `bytes`.

    A row weighs its text's UTF-8 bytes plus 16. Equal texts are neighbours in
    the order, and slots follow the order, so a group of them is cut only where a
    shard ends. `rows_per_bucket` only deals out the work. Null texts
    weigh 16 and are equal to the empty text; null ids and repeated rows are
    rows like any other (a repeated row is told apart by its place). An empty
    table gives an empty result; with fewer rows than shards some stay empty.
    One row heavier than a shard makes that shard as heavy as the row. Other
    columns of the input are neither read nor returned.
    """
    rows = stored(shard_rows(docs, id_col, text_col), "shard-rows")
    keys = sorted(splitters(rows, shards, tolerance, probe_bits))
    placed = rows.select("*", _shard_of(keys).cast("int").alias("shard"))
    return _with_slots(placed, max(0, (rows.count() // rows_per_bucket).bit_length())).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
