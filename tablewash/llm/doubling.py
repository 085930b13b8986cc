"""Substring dedup by level-wise doubling over words.

Windows of about half the length are looked at first; only where such a window
occurs in two documents can a window of twice its length, so only there the
longer ones are made. Below full length not every window is looked at but
one anchor for each window of full length, the smallest hash in it: equal
windows have equal anchors at every level. The levels are gone through until
full length or until no candidate is left. At full length the smallest doc_id
of every window decides what goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import release, slices, stored, utf8

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93))
_CACHED_WORDS = 500_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_words = _WordHashes()


def levels(length: int, lowest: int) -> list[int]:
    """Window lengths from the lowest level up: each at most twice the one before, the last `length`."""
    found = [length]
    while found[0] > max(1, lowest):
        found.insert(0, (found[0] + 1) // 2)
    return found


def _joined(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    found = left * _MIX[salt] + right * _MIX[salt + 1]
    found ^= found >> np.uint64(31)
    found *= _MIX[2]
    return found ^ found >> np.uint64(29)


def window_hashes(words: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of every window of `length` words: two windows of half the length, overlapping if it is odd."""
    if len(words) < length:
        return words[:0]
    if length == 1:
        return words * _MIX[4] ^ np.uint64(salt)
    half = (length + 1) // 2
    below = window_hashes(words, half, salt)
    return _joined(below[: len(words) - length + 1], below[length - half :], salt)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` neighbours."""
    done, found = 1, values
    while done < width:
        step = min(done, width - done)
        found = np.minimum(found[:-step], found[step:])
        done += step
    return found


class _Batch:
    """Words of all texts of a batch in a row; windows across texts are masked."""

    def __init__(self, texts: list[bytes], length: int) -> None:
        self.words: list[bytes] = []
        sizes = []
        for text in texts:
            own = text.split()
            self.words.extend(own)
            sizes.append(len(own))
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.row = np.repeat(np.arange(len(texts)), self.sizes)
        self.hashes = np.fromiter(map(_words.__getitem__, self.words), np.uint64, len(self.words))
        self.whole = np.zeros(max(0, len(self.words) - length + 1), bool)
        if self.whole.size:
            self.whole = self.row[: self.whole.size] == self.row[length - 1 :]

    def anchors(self, length: int, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes at the lowest level, and for each full window the smallest of them in it."""
        below = window_hashes(self.hashes, low)
        return below, _smallest(below, length - low + 1)


def _marked(made: _Batch, least: np.ndarray, marks: pa.Array) -> np.ndarray:
    """Full windows whose anchor is among the repeated ones of their document."""
    owner = np.repeat(np.arange(len(marks)), marks.value_lengths().to_numpy())
    known = marks.flatten().to_numpy().view(np.uint64)
    return _member(least, made.row[: least.size], known, owner) & made.whole


def _anchor_rows(length: int, low: int, spread: bool, below: int | None = None):
    """Per batch: with `spread` each anchor with its smallest and largest text name, else the distinct (anchor, doc).

    With a level `below`, only of full windows whose anchor there is among the document's repeated ones, the third column.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            names = batch.column(0).to_numpy()
            made = _Batch(batch.column(1).to_pylist(), length)
            h, name = np.empty(0, np.uint64), np.empty(0, np.int64)
            if made.whole.any():
                _, least = made.anchors(length, low)
                wanted = made.whole
                if below is not None:
                    wanted = _marked(made, made.anchors(length, below)[1], batch.column(2))
                h, name = least[wanted], names[made.row[: least.size][wanted]]
                # A window and its neighbour mostly share the anchor.
                new = np.ones(h.size, bool)
                new[1:] = (h[1:] != h[:-1]) | (name[1:] != name[:-1])
                h, name = h[new], name[new]
                order = np.lexsort((name, h))
                h, name = h[order], name[order]
            fresh = np.ones(h.size, bool)
            fresh[1:] = h[1:] != h[:-1]
            if spread:
                at = np.flatnonzero(fresh)
                last = np.append(at[1:], h.size) - 1 if at.size else at
                columns, labels = [h[at].view(np.int64), name[at], name[last]], ["h", "low", "high"]
            else:
                fresh[1:] |= name[1:] != name[:-1]
                columns, labels = [h[fresh].view(np.int64), name[fresh]], ["h", "doc"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], labels)

    return cut


def _window_rows(length: int, low: int):
    """(doc, a, b) of full windows whose anchor is among the document's repeated ones; a and b hash the window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            docs = batch.column(0).to_numpy()
            made = _Batch(batch.column(1).to_pylist(), length)
            a = b = np.empty(0, np.uint64)
            doc = np.empty(0, np.int64)
            if made.whole.any():
                _, least = made.anchors(length, low)
                wanted = _marked(made, least, batch.column(2))
                a = window_hashes(made.hashes, length)[wanted]
                b = window_hashes(made.hashes, length, 1)[wanted]
                doc = docs[made.row[: least.size][wanted]]
                order = np.lexsort((b, a, doc))
                a, b, doc = a[order], b[order], doc[order]
                fresh = np.ones(a.size, bool)
                fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (doc[1:] != doc[:-1])
                a, b, doc = a[fresh], b[fresh], doc[fresh]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["doc", "a", "b"]
            )

    return cut


def _member(values: np.ndarray, rows: np.ndarray, known: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether (row, value) is among the (owner, known) pairs."""
    if not known.size:
        return np.zeros(values.size, bool)
    order = np.lexsort((owner, known))
    known, owner = known[order], owner[order]
    names, at = np.unique(known, return_inverse=True)
    place = np.minimum(np.searchsorted(names, values), names.size - 1)
    same = names[place] == values
    span = int(max(rows.max(initial=0), owner.max(initial=0))) + 1
    pairs = at * span + owner
    found = np.zeros(values.size, bool)
    asked = place[same] * span + rows[same]
    spot = np.minimum(np.searchsorted(pairs, asked), pairs.size - 1)
    found[same] = pairs[spot] == asked
    return found


def _name(text: bytes) -> int:
    """What xxhash64 gives in a query."""
    found = xxhash.xxh64_intdigest(text, 42)
    return found - (1 << 64) if found >> 63 else found


def removed_windows(docs: DataFrame, length: int = 13, lowest: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, removed and copies, for documents that lose words.

    removed: hashes of its windows that also start in a document with a smaller
    id; copies: names of texts that a document with a smaller id has as a whole.
    """
    low = levels(length, lowest)
    text = utf8(F.col(text_col))
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text.alias("text"))
    # Equal texts: the one with the smallest id stands for all.
    name = F.xxhash64("text")
    digests = stored(texts.select("doc", name.alias("t1"), F.xxhash64(F.concat(F.lit(b"2"), F.col("text"))).alias("t2")), "digests")
    owners = digests.groupBy(F.col("t1").alias("o1"), F.col("t2").alias("o2")).agg(F.min("doc").alias("own"))
    owned = stored(digests.join(owners, (F.col("t1") == F.col("o1")) & (F.col("t2") == F.col("o2"))).select("doc", "t1", "own"), "owned")
    standing = owned.filter("doc = own").select(F.col("doc").alias("s")).distinct()
    copies = owned.filter("doc > own").groupBy(F.col("doc").alias("c")).agg(F.collect_set("t1").alias("copies"))

    def repeated_anchors(named: DataFrame, owned_rows: DataFrame, level: int, below: int | None, round_: str) -> DataFrame:
        """(d, marks): the anchors of a level that occur in two texts, by document."""
        spread = named.mapInArrow(_anchor_rows(length, level, True, below), "h long, low long, high long")
        repeated = stored(
            spread.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select(F.col("h").alias("k")),
            f"anchors{round_}",
        )
        release(docs.sparkSession)
        own = owned_rows.mapInArrow(_anchor_rows(length, level, False, below), "h long, doc long").join(repeated, F.col("h") == F.col("k"))
        marks = own.groupBy(F.col("doc").alias("d")).agg(F.collect_set("h").alias("marks"))
        marks = stored(marks.join(standing, F.col("d") == F.col("s"), "left_semi"), f"marks{round_}")
        release(docs.sparkSession)
        return marks

    below = low[0]
    marks = repeated_anchors(texts.select(name.alias("t1"), "text"), texts, below, None, "")
    for level in low[1:-1]:
        if marks.isEmpty():
            break
        # Doubled: only full windows over a repeated anchor go on.
        marked = texts.join(marks, F.col("doc") == F.col("d")).select("doc", "text", "marks")
        named = marked.select(name.alias("t1"), "text", "marks")
        marks, below = repeated_anchors(named, marked, level, below, f"-{level}"), level
    # Doubled to full length.
    marked = texts.join(marks, F.col("doc") == F.col("d")).select("doc", "text", "marks")
    windows = stored(marked.mapInArrow(_window_rows(length, below), "doc long, a long, b long"), "windows")
    release(docs.sparkSession)
    first = windows.groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n"))
    first = stored(first.filter("n > 1").select("x", "y", "least"), "first")
    release(docs.sparkSession)
    later = windows.join(first, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")) & (F.col("doc") > F.col("least")))
    found = later.groupBy(F.col("doc").alias("w")).agg(F.collect_set("a").alias("removed"))
    found = stored(found.join(copies, F.col("w") == F.col("c"), "full").select(F.coalesce("w", "c").alias("doc"), "removed", "copies"), "removed")
    release(docs.sparkSession)
    return found


def remove_repeated_windows(
    docs: DataFrame, length: int = 13, lowest: int = 7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by one space) of every document.

    A word goes if a window of `length` words over it also starts in a document
    with a smaller id. Words are runs of anything but space and the ASCII
    controls from tab to carriage return. Null and empty texts have no words.
    Windows are compared by two 64-bit hashes over 64-bit hashes of their words. Rows that share an id are one
    document to each other: neither removes from the other. Rows with a null id
    neither remove nor lose words. Ids are whole numbers. Other columns of the
    input are neither read nor returned; an empty table gives an empty result.
    """
    gone = removed_windows(docs, length, lowest, id_col, text_col)
    asked = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    joined = asked.join(gone, F.col("doc_id").cast("long") == F.col("doc"), "left").select("doc_id", "text", "removed", "copies")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            counts, removed, digests, texts = [], [], [], []
            for text, own, copied in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                counts.append(len(words))
                if len(words) < length:
                    pass
                elif copied and _name(text) in copied:
                    words = []
                elif own.is_valid:
                    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
                    starts = np.isin(window_hashes(h, length), own.values.to_numpy().view(np.uint64))
                    edge = np.zeros(len(words) + 1, np.int64)
                    edge[: starts.size] += starts
                    edge[length : length + starts.size] -= starts
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                removed.append(counts[-1] - len(words))
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
