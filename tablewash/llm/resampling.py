"""Quality classifier by importance resampling.

Two generative models over hashed word 1- and 2-grams, one of the target texts
(labelled good) and one of the raw corpus (every document), give each document
the log ratio of its likelihoods. Adding Gumbel noise and keeping the k largest
samples k documents without replacement in proportion to these weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import hash_sample, map_rows, map_texts, nth_smallest, slices, stored, utf8

_TOKENS = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff]+")
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_CACHED_WORDS = 150_000


class _Hashes(dict):
    """Hashes of the tokens in a word: letters, digits and bytes above ASCII against the rest."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        found = tuple(xxhash.xxh64_intdigest(t) for t in _TOKENS.findall(word))
        self[word] = found
        return found


_hashes = _Hashes()


def grams(text: bytes, bits: int) -> np.ndarray:
    """Buckets of all 1-grams and 2-grams of a text, repeats included."""
    tokens = list(chain.from_iterable(map(_hashes.__getitem__, text.lower().split())))
    h = np.array(tokens, np.uint64)
    drop = np.uint64(64 - bits)
    single = h * _MIX[0]
    double = h[:-1] * _MIX[1] + h[1:] * _MIX[2]
    both = np.concatenate([single, double])
    both ^= both >> np.uint64(29)
    return ((both * _MIX[3]) >> drop).astype(np.int64)


@dataclass(frozen=True)
class Models:
    """Log ratio of target to raw probability for every bucket."""

    ratio: np.ndarray
    bits: int

    def log_weight(self, text: bytes) -> float:
        return float(self.ratio[grams(text, self.bits)].sum())


def gumbel(doc_id: int | None, seed: int) -> float:
    """Standard Gumbel noise that depends on id and seed alone, so that a retried task draws the same."""
    h = xxhash.xxh64_intdigest(b"" if doc_id is None else str(doc_id).encode(), seed)
    return float(-np.log(-np.log((h + 0.5) / 2.0**64)))


def sortable(value: float) -> int:
    """A signed 64-bit integer that sorts as the double does."""
    bits = int(np.float64(value + 0.0).view(np.int64))
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF) - 1


def fit(docs: DataFrame, target: DataFrame, bits: int = 16, target_docs: int = 20_000, smoothing: float = 1.0) -> Models:
    """Count n-grams of all documents (raw) and of at most `target_docs` target documents.

    `target` holds ids (doc_id) of labelled good documents; those with the
    smallest seeded hash are taken. Each task adds up its own counts; what
    comes to the driver is one pair of sums for each of the 2**bits buckets.
    Without target documents the ratio is 0 throughout.
    """
    ids = [r["doc_id"] for r in hash_sample(target, "doc_id", target_docs).collect()]
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids], "_id long")
    flagged = docs.select("doc_id", utf8(F.col("text")).alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left"
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in slices(batches, 0):
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.bincount(grams(text, bits), minlength=1 << bits) if len(text) > 200_000 else None
                at = grams(text, bits) if own is None else None
                for total in (raw, good) if wanted else (raw,):
                    if own is None:
                        np.add.at(total, at, 1)
                    else:
                        total += own
        there = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (there, raw[there], good[there])], ["bucket", "raw", "good"])

    counts = (
        flagged.select("text", F.col("_id").isNotNull().alias("wanted"))
        .mapInArrow(counted, "bucket long, raw long, good long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
        .toArrow()
    )
    raw, good = np.zeros(1 << bits), np.zeros(1 << bits)
    at = counts["bucket"].to_numpy()
    raw[at], good[at] = counts["raw"].to_numpy(), counts["good"].to_numpy()
    if not good.sum():
        return Models(np.zeros(1 << bits), bits)
    # Both are smoothed towards the raw model, so that a bucket unseen in the target is rare, not impossible.
    base = (raw + smoothing) / (raw.sum() + smoothing * raw.size)
    target_p = (good + smoothing * base * raw.size) / (good.sum() + smoothing * raw.size)
    return Models(np.log(target_p / base), bits)


def score(docs: DataFrame, models: Models, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, gumbel_key (weight plus noise) and the key as a sortable long."""

    def scored(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        weights = [models.log_weight(t) for t in texts]
        keys = [w + gumbel(i, seed) for w, i in zip(weights, ids.to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(weights, pa.float64()), pa.array(keys, pa.float64()), pa.array(map(sortable, keys), pa.int64())],
            ["doc_id", "log_weight", "gumbel_key", "rank_key"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, scored, f"doc_id {kind}, log_weight double, gumbel_key double, rank_key long", id_col, text_col)


def good_share(labels: DataFrame, errors: float = 2.0) -> float:
    """Share of labelled documents that are good plus `errors` standard errors, in favour of keeping; 1 without labels."""
    share, n = labels.agg(F.avg((F.col("quality") == 1).cast("double")), F.count("quality")).first()
    return 1.0 if share is None else min(1.0, share + errors * (share * (1 - share) / n) ** 0.5)


def threshold(scores: DataFrame, share: float) -> int | None:
    """The sortable key of the k-th largest, k = ceil(share * rows); None if all stay."""
    n = scores.count()
    k = int(np.ceil(share * n))
    if k >= n:
        return None
    found = nth_smallest(scores, "rank_key", n - k + 1) if k else None
    return found[0] if found else 2**63 - 1


def resample(docs: DataFrame, labels: DataFrame, bits: int = 16, seed: int = 42, share: float | None = None) -> DataFrame:
    """Every document with log_weight, gumbel_key and whether the top-k sample keeps it.

    k is `share` of the rows; by default the share of good ones among `labels`
    (doc_id, quality) plus two standard errors. Rows that tie with the k-th stay too, so
    equal rows share their fate. Null and empty texts have weight 0; null ids
    share one noise value. Without labels every document stays. Other columns
    of the input are neither read nor returned.
    """
    models = fit(docs, labels.filter(F.col("quality") == 1), bits)
    scores = stored(score(docs, models, seed), "resampling-scores")
    least = threshold(scores, good_share(labels) if share is None else share)
    kept = F.lit(True) if least is None else F.col("rank_key") >= least
    return scores.select("doc_id", "log_weight", "gumbel_key", kept.alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame, bits: int = 16, seed: int = 42, share: float | None = None) -> DataFrame:
    """The documents that the sample keeps, with all their columns.

    Scores are made again while the rows pass, instead of joining them to texts
    by id: no text is shuffled, and rows that share an id are judged by their own text.
    """
    models = fit(docs, labels.filter(F.col("quality") == 1), bits)
    least = threshold(stored(score(docs, models, seed), "resampling-scores"), good_share(labels) if share is None else share)
    if least is None:
        return docs

    position = docs.columns.index("text")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, position):
            ids, texts = batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("text"))
            keep = [
                sortable(models.log_weight((t or "").encode()) + gumbel(i, seed)) >= least
                for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_rows(docs, passed, docs.schema)
