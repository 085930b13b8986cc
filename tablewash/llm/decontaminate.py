"""Benchmark decontamination: test items inside long documents, by MinHash containment.

A test item of n shingles is held by a document if at least `need` of them are,
and then any n - need + 1 of them include one that is. So the n - need + 1
smallest hashes of an item, its bottom sketch, must meet the document: a MinHash
search that misses nothing. Items are partitioned by size, and a document is
compared only with the partitions whose items it is long enough to hold. What
meets is verified by counting shared shingles, compared as texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import free_names, slices, stored, utf8

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_CACHED_WORDS = 150_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_words = _WordHashes()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` words; of the whole sequence if it is shorter."""
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    count = len(words) - n + 1
    if not words:
        return h
    found = np.full(count, n, np.uint64)
    for k in range(n):
        found = found * _MIX[0] + h[k : k + count]
        found ^= found >> np.uint64(29)
        found *= _MIX[1]
    found ^= found >> np.uint64(32)
    return found * _MIX[2]


def shingles(words: list[bytes], size: int, at: int) -> bytes:
    return b" ".join(words[at : at + size])


def item_shingles(items: DataFrame, size: int, share: float, id_col: str, text_col: str) -> DataFrame:
    """item_id, shingle, hash, n (distinct shingles), need, class (of size) and in_sketch for every item's shingle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.lower().split()
                own: dict[bytes, int] = {}
                for at, h in enumerate(shingle_hashes(words, size).view(np.int64).tolist()):
                    own[shingles(words, size, at)] = h
                n = len(own)
                # Smallest whole number that is at least share * n; the guard takes off what doubles add.
                need = int(np.ceil(share * n - 1e-9))
                order = sorted(own.items(), key=lambda x: (x[1] & 0xFFFFFFFFFFFFFFFF, x[0]))
                for place, (shingle, h) in enumerate(order):
                    rows.append((item, shingle, h, n, need, n.bit_length(), place <= n - need))
            kinds = [batch.schema.field(0).type, pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["item_id", "shingle", "hash", "n", "need", "class", "in_sketch"],
            )

    kind = items.schema[id_col].dataType.simpleString()
    schema = f"item_id {kind}, shingle binary, hash long, n long, need long, class int, in_sketch boolean"
    asked = items.select(F.col(id_col), utf8(F.col(text_col))).distinct()
    return asked.mapInArrow(cut, schema)


@dataclass(frozen=True)
class _Partition:
    """Items of a size class and below: which hash prefixes occur, and the shortest document that can hold one."""

    least: int
    sketch: np.ndarray  # by prefix: some sketch holds a hash with it
    every: np.ndarray  # by prefix: some item does


def _partitions(items: DataFrame, bits: int) -> list[_Partition]:
    """Hash prefixes of the items by size class; at most 2**bits bits for each of the classes, whatever the items."""
    drop = F.shiftrightunsigned("hash", 64 - bits)
    found = items.groupBy("class", drop.alias("p")).agg(F.min("need").alias("need"), F.max("in_sketch").alias("s")).toArrow()
    kinds, places = found["class"].to_numpy(), found["p"].to_numpy()
    need, sketch = found["need"].to_numpy(), found["s"].to_numpy(zero_copy_only=False)
    out: list[_Partition] = []
    held = np.zeros((2, 1 << bits), bool)
    for kind in np.unique(kinds):
        own = kinds == kind
        held = held.copy()
        held[0, places[own & sketch]] = True
        held[1, places[own]] = True
        out.append(_Partition(int(need[own].min()), held[0], held[1]))
    return out


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    share: float = 0.8,
    size: int = 5,
    bits: int = 22,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, text_hash, item_id, shared, item_shingles, containment for every document and item it holds.

    Shingles are `size` words in lower case (A-Z), as distinct texts; a text of
    fewer words is one shingle. A document holds an item if it has at least
    `share` of the item's shingles. Null and empty items and documents hold and
    are held by nothing. Rows of documents with equal id and equal text count
    once (text_hash is the text's XXH64); so do repeated items. Items with equal
    id and different texts are told apart only by their shingles' number. Other
    columns of the inputs are neither read nor returned.
    """
    cut = stored(item_shingles(items, size, share, item_id_col, item_text_col), "item-shingles")
    partitions = _partitions(cut, bits)
    shipped = docs.sparkSession.sparkContext.broadcast(partitions)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The longest document decides which partitions apply; each adds the classes below it.
        levels = shipped.value
        drop = np.uint64(64 - bits)
        for batch in slices(batches, 2):
            who, hashes, found = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                words = text.lower().split()
                own = shingle_hashes(words, size)
                level = next((p for p in reversed(levels) if p.least <= len(own)), None)
                if level is None:
                    continue
                prefix = (own >> drop).astype(np.int64)
                if not level.sketch[prefix].any():
                    continue
                at = np.flatnonzero(level.every[prefix])
                for h, start in zip(own[at].view(np.int64).tolist(), at.tolist(), strict=True):
                    who.append(row)
                    hashes.append(h)
                    found.append(shingles(words, size, start))
            rows = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hashes, pa.int64()), pa.array(found, pa.binary())],
                ["doc_id", "text_hash", "d_hash", "d_shingle"],
            )

    text = utf8(F.col(text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    hits = (
        docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
        .mapInArrow(met, f"doc_id {kind}, text_hash long, d_hash long, d_shingle binary")
        .distinct()
    )
    matched = hits.join(cut, (F.col("d_hash") == F.col("hash")) & (F.col("d_shingle") == F.col("shingle")))
    return (
        matched.groupBy("doc_id", "text_hash", "item_id", "n", "need")
        .agg(F.count(F.lit(1)).alias("shared"), F.max("in_sketch").alias("candidate"))
        .filter(F.col("candidate") & (F.col("shared") >= F.col("need")))
        .select(
            "doc_id", "text_hash", "item_id", "shared", F.col("n").alias("item_shingles"),
            (F.col("shared") / F.col("n")).alias("containment"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.8, size: int = 5) -> DataFrame:
    """The documents that hold no item, with all their columns; rows are judged by their own text."""
    of, digest = free_names(docs.columns, "of", "digest")
    found = contained_items(docs, items, share, size).select(F.col("doc_id").alias(of), F.col("text_hash").alias(digest))
    bad = stored(found.distinct(), "contaminated")
    text = utf8(F.col("text"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(digest)), "left_anti")
