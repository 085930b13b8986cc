"""SimHash near-duplicates by a self-join of a binary trie over fingerprints.

Pairs of trie nodes are descended together, block by block. The bits in which
the two prefixes differ add up on the way down, and a pair is dropped once they
exceed what is allowed at its depth. With k errors allowed the 64 bits are cut into k + 1 blocks and the trie
is walked in the k + 1 bit orders that begin with another block: for any pair
within k errors one of these orders has at most j - 1 errors in its first j
blocks, whatever j (a sum of k + 1 numbers that is at most k has a rotation
whose partial sums all stay that low). So the walk may start from equal first
blocks and stays narrow at every depth; no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tablewash.llm.common import free_names, map_rows, map_texts, quoted, slices, stored
from tablewash.llm.components import connected_components

_SHINGLE = 4
_SEED = 42
_CHUNK = 1 << 18


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text's 4-word shingles, as an unsigned integer; 0 without words."""
    words = text.lower().split()
    n = len(words) - _SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(b" ".join(words), _SEED) if words else 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    begins = (ends[: n] - sizes[: n] + 1).tolist()
    ends = ends[_SHINGLE - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = [digest(joined[b:e], _SEED) for b, e in zip(begins[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)]
        octets = np.array(part, ">u8").view(np.uint8).reshape(-1, 8)
        if len(part) < 512:
            ones += np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
        else:
            for i in range(8):
                ones[8 * i : 8 * i + 8] += np.bincount(octets[:, i], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


#: Row v: the bits of the byte v, highest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def hashed(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        found = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([ids, pa.array(found)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, hashed, f"doc_id {kind}, fp long", id_col, text_col)


def _rotated(bits: Column, left: int) -> Column:
    return bits if not left else F.shiftleft(bits, left).bitwiseOR(F.shiftrightunsigned(bits, 64 - left))


def close_pairs(prints: DataFrame, errors: int = 4) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) that differ in at most `errors` bits.

    A pair can be found in several bit orders; it is given once.
    """
    blocks = errors + 1
    cuts = [round(64 * j / blocks) for j in range(blocks + 1)]
    widths = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    starts = cuts[:-1]
    if errors < 1:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    # Every fingerprint in every bit order, with its prefixes of two, three, ... blocks.
    turns = []
    for o, start in enumerate(starts):
        bits = _rotated(F.col("fp"), start)
        depth = [sum((widths[o:] + widths[:o])[:n]) for n in range(2, blocks + 1)]
        turns.append(F.struct(F.lit(o).alias("o"), *(F.shiftrightunsigned(bits, 64 - d).alias(f"p{j}") for j, d in enumerate(depth, 1))))
    turned = prints.select(F.explode(F.array(*turns)).alias("x")).select("x.*")

    def nodes(j: int) -> DataFrame:
        """Trie nodes of j + 1 blocks: order, prefix p, the parent's prefix up, and how many fingerprints lie below."""
        up = [F.col(f"p{j - 1}").alias("up")] if j > 1 else []
        return turned.groupBy("o", F.col(f"p{j}").alias("p"), *up).agg(F.count(F.lit(1)).alias("n"))

    first = nodes(1)
    second = F.element_at(F.array(*map(F.lit, widths[1:] + widths[:1])), F.col("o") + 1)
    # Of two nodes that differ in one bit of the second block, the one with the bit unset meets the other.
    flips = F.array_compact(
        F.array(
            *(
                F.when((second > i) & (F.col("p").bitwiseAND(F.lit(1 << i)) == 0), F.col("p") + (1 << i))
                for i in range(max(widths))
            )
        )
    )
    other = first.select(F.col("o").alias("oo"), F.col("p").alias("q"))
    pairs = (
        first.select("o", F.col("p").alias("a"), F.explode(flips).alias("b"))
        .join(other, (F.col("o") == F.col("oo")) & (F.col("b") == F.col("q")))
        .select("o", "a", "b")
        .union(first.filter("n > 1").select("o", F.col("p").alias("a"), F.col("p").alias("b")))
    )
    for j in range(2, blocks):
        pairs = stored(pairs, "trie-pairs")
        below = nodes(j)
        left = below.select(F.col("o").alias("o1"), F.col("up").alias("up1"), F.col("p").alias("p1"), F.col("n").alias("n1"))
        right = below.select(F.col("o").alias("o2"), F.col("up").alias("up2"), F.col("p").alias("p2"))
        met = pairs.join(left, (F.col("o") == F.col("o1")) & (F.col("a") == F.col("up1"))).join(
            right,
            (F.col("o") == F.col("o2"))
            & (F.col("b") == F.col("up2"))
            & (F.bit_count(F.col("p1").bitwiseXOR(F.col("p2"))) <= j)
            # Below one node each pair counts once, and a child meets itself only if it holds two fingerprints.
            & ((F.col("a") != F.col("b")) | (F.col("p1") < F.col("p2")) | ((F.col("p1") == F.col("p2")) & (F.col("n1") > 1))),
        )
        pairs = met.select("o", F.col("p1").alias("a"), F.col("p2").alias("b"))

    def turned_back(bits: str) -> Column:
        found = F.lit(None).cast("long")
        for o, start in enumerate(starts):
            found = F.when(F.col("o") == o, _rotated(F.col(bits), (64 - start) % 64)).otherwise(found)
        return found

    ends = pairs.filter("a <> b").select(turned_back("a").alias("a"), turned_back("b").alias("b"))
    return ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(prints: DataFrame, errors: int = 4) -> DataFrame:
    """Of every distinct fp: its component's smallest fp and smallest doc_id, and its number of links."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    links = stored(close_pairs(distinct.select("fp"), errors), "links")
    names = connected_components(links)
    degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    named = (
        distinct.join(names, F.col("fp") == F.col("node"), "left")
        .join(degree, F.col("fp") == F.col("a"), "left")
        .select("fp", "least", F.coalesce("component", "fp").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    named = stored(named, "named")
    smallest = named.groupBy(F.col("component").alias("of")).agg(F.min("least").alias("component_id"))
    return named.join(smallest, F.col("component") == F.col("of")).select("fp", "component", "component_id", "n_links")


def near_duplicates(docs: DataFrame, errors: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and n_links of every document.

    Shingles are four words of the text in lower case (A-Z), separated by runs
    of ASCII white space; under four words the whole sequence is one shingle.
    Equal fingerprints are one node; `n_links` counts the other fingerprints
    within `errors` bits. Null, empty and blank texts have the fingerprint zero
    and link like any other. Repeated rows give repeated rows; rows with a null
    id take part and get the smallest id reachable, null if there is none.
    Other columns of the input are neither read nor returned.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    found = groups(prints, errors).withColumnRenamed("fp", "_fp")
    return prints.join(found, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links"
    )


def keep_one_of_each_group(docs: DataFrame, errors: int = 4) -> DataFrame:
    """The documents (doc_id, text and any other columns) without near-duplicates: of each group the smallest doc_id stays.

    Rows without id come last in a group; of rows that repeat id and
    fingerprint one stays. Columns are returned as they came.
    """
    mark, one, bits = free_names(docs.columns, "fp", "one", "bits")
    position = docs.columns.index("text")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, position):
            found = [fingerprint((t or "").encode()) for t in batch.column(position).to_pylist()]
            column = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, mark])

    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = stored(fingerprints(docs), "prints")
    found = groups(prints, errors)
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("fp").alias("f"))
    members = prints.select("doc_id", "fp").distinct().join(found.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp"))
    best = members.groupBy("component").agg(F.min(order).alias("b"))
    keepers = best.select(F.col("b.i").cast(kind).alias(one), F.col("b.f").alias(bits))
    schema = StructType([*docs.schema.fields, StructField(mark, LongType())])
    with_mark = map_rows(docs, marked, schema)
    kept = with_mark.join(keepers, F.col("doc_id").eqNullSafe(F.col(one)) & (F.col(mark) == F.col(bits)), "left_semi")
    return kept.dropDuplicates(["doc_id", mark]).select(*map(quoted, docs.columns))
