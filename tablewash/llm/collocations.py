"""Phrase collocations from a weighted de Bruijn graph.

The graph's nodes are phrases of one word less than the longest, its edges the
longest phrases, weighted by how often they occur; neighbouring edges overlap in
a node. Only edges are counted, and where no frequent edge can begin, the longest
phrase that may be frequent. How often a shorter phrase occurs is what flows out
of it along the edges and these shorter ones. A node whose whole flow goes on along one
edge is compacted into it: a phrase that never occurs but within a longer one goes.

A phrase can only be frequent if all phrases in it are, so pieces are cut at rare
pairs first, and longer phrases that are rare are left out. Which are rare is told
by two bit maps of fixed size: a wrong bit keeps a rare phrase, which costs time,
never a count. The counts behind the maps travel packed, some two bytes each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewash.llm.common import slices, stored, utf8

#: Bits of each map of frequent phrases: 8 MB whatever the corpus.
MAP_BITS = 1 << 26
#: Hashes that are told apart in the shuffle for the map: rare ones may count as one, which at worst is a wrong bit.
_HASH_VALUES = 1 << 32
#: Bytes of text a task looks at in one go, entries it counts before it hands them on, and rows it hands on at once.
_BYTES, _BLOCK, _ROWS = 1 << 19, 1 << 21, 1 << 16
#: Packed counts: values of a range, and of a part of it in which 16 bits tell them apart.
_RANGE, _SUB = 1 << 21, 1 << 16
NO_LANGUAGE = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What separates words within a piece, and what ends a piece.
_BLANK, _END = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANK)], _KIND[list(_END)] = 1, 2
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX[1]
    return (x ^ x >> np.uint64(29)) * _MIX[2] ^ x >> np.uint64(32)


class _Hasher:
    """64-bit hashes of all words of a block at once: differences of a running polynomial over its bytes."""

    def __init__(self, seed: int) -> None:
        self._bytes = np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)
        self._base = int(self._bytes[0]) | 1
        self._powers = self._inverse = np.ones(1, np.uint64)

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._powers.size <= data.size:
            for name, base in (("_powers", self._base), ("_inverse", pow(self._base, -1, 1 << 64))):
                steps = np.full(data.size + 1, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        run = np.zeros(data.size + 1, np.uint64)
        np.cumsum(self._bytes[data] * self._powers[: data.size], out=run[1:])
        return _mixed((run[end] - run[start]) * self._inverse[start] + (end - start).astype(np.uint64))


_hashers: dict[int, _Hasher] = {}


class _Block:
    """The words of some texts: bytes lower-cased, where words start and end, which words are neighbours in a piece."""

    def __init__(self, texts: list[bytes], languages: list[str]) -> None:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.data = _LOWER[raw]
        kind = _KIND[raw]
        letter = np.zeros(raw.size + 1, bool)
        letter[1:] = kind == 0
        edges = np.flatnonzero(letter[1:] != letter[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        ends = np.cumsum(kind == 2, dtype=np.int32)[self.start]
        self.near = ends[1:] == ends[:-1]
        first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.names, codes = np.unique(np.array(languages, object), return_inverse=True) if texts else (np.array([], object), [])
        self.language = np.asarray(codes, np.int64)[np.searchsorted(first, self.start, "right") - 1]
        salts = [xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) for x in self.names]
        self.salt = np.array(salts, np.uint64)[self.language]

    def hashes(self, seed: int) -> np.ndarray:
        hasher = _hashers.setdefault(seed, _Hasher(seed))
        return _mixed(hasher.words(self.data, self.start, self.end) ^ self.salt)

    def text(self, word: int, words: int) -> bytes:
        found = self.data[self.start[word] : self.end[word + words - 1]].tobytes()
        if b"\t" in found or b"  " in found:
            found = b" ".join(w for w in found.replace(b"\t", b" ").split(b" ") if w)
        return found


def _pairs(h: np.ndarray) -> np.ndarray:
    return _mixed(h[:-1] * _MIX[0] + h[1:])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """Columns lang and text."""
    for batch in slices(batches, 1, _BYTES):
        if batch.num_rows:
            yield _Block(batch.column(1).to_pylist(), batch.column(0).to_pylist())


def _grams(h: np.ndarray, linked: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of words, first words and hashes of the phrases of 3 words and more along links."""
    at = np.flatnonzero(linked)
    key = _pairs(h)[at] if at.size else h[:0]
    for words in range(3, longest + 1):
        on = linked[at + words - 2]
        at = at[on]
        key = _mixed(key[on] * _MIX[0] + h[at + words - 1] + np.uint64(words))
        yield words, at, key


def _words_and_pairs(block: _Block) -> list[np.ndarray]:
    h = block.hashes(0)
    return [h, _pairs(h)[block.near]]


def _links(block: _Block, h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether a word and the next one are a pair that may be frequent."""
    linked = np.zeros(h.size, bool)
    linked[:-1] = block.near & _marked(bitmap, _pairs(h))
    return linked


def _hashed_counts(
    batches: Iterator[pa.RecordBatch], values: int, hashes: Callable[[_Block], list[np.ndarray]] = _words_and_pairs
) -> Iterator[pa.RecordBatch]:
    """(h, c) of the phrases' hashes, counted and in order within blocks; h is below `values`, a power of two."""
    low = np.uint64(values - 1)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held) & low, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    held, size = [], 0
    for block in _blocks(batches):
        if block.start.size:
            held += hashes(block)
            size = sum(x.size for x in held)
        if size >= _BLOCK:
            yield counted(held)
            held, size = [], 0
    if held:
        yield counted(held)


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of the values between each two bounds."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), bounds.size - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


_PACKED = "at int, one_sizes binary, ones binary, more_sizes binary, more binary, times binary"


def _packed(counts: Iterator[pa.RecordBatch], values: int) -> Iterator[pa.RecordBatch]:
    """A row for each range of hashes: those met once and those met more often by their last 16 bits, and how often."""
    parts, names = _RANGE // _SUB, [c.split()[0] for c in _PACKED.split(", ")]
    starts = np.arange(0, values + 1, _RANGE)
    for batch in counts:
        h, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        columns = []
        for chosen in (c == 1, c > 1):
            own = h[chosen]
            sizes = np.bincount(own // _SUB, minlength=values // _SUB).astype("<u4")
            columns += [_binary(sizes, np.arange(starts.size) * parts), _binary((own % _SUB).astype("<u2"), np.searchsorted(own, starts))]
        columns.append(_binary(c[c > 1].astype("<i8"), np.searchsorted(h[c > 1], starts)))
        rows = pa.RecordBatch.from_arrays([pa.array(np.arange(starts.size - 1, dtype=np.int32)), *columns], names)
        yield rows.filter(pa.array(np.diff(np.searchsorted(h, starts)) > 0))


def _unpacked(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """(h) of the hashes met `min_count` times, from packed rows in the order of `at`: counters of one range at a time."""
    counters, now = np.zeros(_RANGE, np.int64), None

    def found() -> pa.RecordBatch:
        h = np.flatnonzero(counters >= min_count) + (0 if now is None else now * _RANGE)
        counters[:] = 0
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64())], ["h"])

    def places(sizes: bytes, low: bytes) -> np.ndarray:
        high = np.repeat(np.arange(_RANGE // _SUB), np.frombuffer(sizes, "<u4"))
        return high * _SUB + np.frombuffer(low, "<u2")

    for batch in batches:
        for at, one_sizes, ones, more_sizes, more, times in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if at != now:
                yield found()
                now = at
            counters[places(one_sizes, ones)] += 1
            counters[places(more_sizes, more)] += np.frombuffer(times, "<i8")
    yield found()


def _bit_map(texts: DataFrame, min_count: int, bits: int, hashes: Callable[[_Block], list[np.ndarray]]) -> np.ndarray:
    """A bit map with the bits of all phrases that occur `min_count` times: bits / 64 longs, whatever the corpus."""
    bit = F.col("h").bitwiseAND(F.lit(bits - 1))
    values = max(bits, _HASH_VALUES)
    packed = texts.mapInArrow(lambda batches: _packed(_hashed_counts(batches, values, hashes), values), _PACKED)
    dealt = packed.repartition("at").sortWithinPartitions("at")
    frequent = dealt.mapInArrow(lambda batches: _unpacked(batches, max(min_count, 1)), "h long").select(
        F.shiftright(bit, 6).alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("set")
    )
    found = np.zeros(bits // 64, np.int64)
    for row in frequent.groupBy("at").agg(F.bit_or("set").alias("set")).toLocalIterator():
        found[row["at"]] = row["set"]
    return found.view(np.uint64)


def frequent_map(texts: DataFrame, min_count: int, bits: int = MAP_BITS) -> np.ndarray:
    """The bits of all words and pairs that occur `min_count` times."""
    return _bit_map(texts, min_count, bits, _words_and_pairs)


def longer_map(texts: DataFrame, bitmap: np.ndarray, min_count: int, longest: int, bits: int = MAP_BITS) -> np.ndarray:
    """The bits of all phrases of 3 to `longest` words that occur `min_count` times, given the map of words and pairs."""
    if longest < 3:
        return np.zeros(bits // 64, np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def longer(block: _Block) -> list[np.ndarray]:
        h = block.hashes(0)
        return [key for _, _, key in _grams(h, _links(block, h, shared.value), longest)]

    return _bit_map(texts, min_count, bits, longer)


def _marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(bitmap.size * 64 - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _edge_rows(block: _Block, bitmap: np.ndarray, longer: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of the longest phrase from each word on that may be frequent, if any is."""
    h = block.hashes(0)
    linked = _links(block, h, bitmap)
    words = np.where(linked, 2, _marked(bitmap, h).astype(np.int64))
    for size, at, key in _grams(h, linked, longest):
        # What begins with a rare phrase, or ends with one, is rare.
        on = _marked(longer, key) & (words[at] == size - 1) & (words[at + 1] >= size - 1)
        words[at[on]] = size
    start = np.flatnonzero(words)
    return start, words[start]


def weighted_edges(texts: DataFrame, bitmap: np.ndarray, longer: np.ndarray, longest: int) -> DataFrame:
    """(lang, phrase, words, c): edges have `longest` words, phrases where none begins fewer; 0 words: all words of a language."""
    shared = texts.sparkSession.sparkContext.broadcast((bitmap, longer))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for block in _blocks(batches):
            if not block.start.size:
                continue
            start, words = _edge_rows(block, *marks, longest)
            keys = []
            for seed in (0, 1):  # 128 bits tell the phrases of a block apart
                h = block.hashes(seed)
                key = np.full(start.size, np.uint64(seed)) + words.astype(np.uint64)
                for k in range(longest):
                    inside = np.flatnonzero(words > k)
                    key[inside] = _mixed(key[inside] * _MIX[0] + h[start[inside] + k])
                keys.append(key)
            order = np.lexsort(keys)
            a, b = keys[0][order], keys[1][order]
            new = np.ones(order.size, bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, order.size))
            chosen = order[at]
            start, words = start[chosen], words[chosen]
            language = block.language[start]
            phrases = [block.text(s, k) for s, k in zip(start.tolist(), words.tolist(), strict=True)]
            totals = np.bincount(block.language, minlength=block.names.size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.names[np.concatenate([language, np.arange(totals.size)])], pa.string()),
                    pa.array(phrases + [b""] * totals.size, pa.binary()),
                    pa.array(np.concatenate([words, np.zeros(totals.size, np.int64)]), pa.int32()),
                    pa.array(np.concatenate([times, totals]), pa.int64()),
                ],
                ["lang", "phrase", "words", "c"],
            )

    rows = texts.mapInArrow(cut, "lang string, phrase binary, words int, c long")
    return (
        rows.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "c")
        .groupBy("lang", "phrase", "words")
        .agg(F.sum("c").alias("c"))
    )


def phrase_counts(edges: DataFrame, min_count: int, longest: int) -> DataFrame:
    """(lang, phrase, words, f) of all phrases that occur `min_count` times, and the row of 0 words of every language.

    What flows out of a node along its edges are the beginnings of the edges, and
    of the shorter phrases that stand where no edge begins.
    """
    within = F.expr(
        f"""if(words = 0, array(struct(phrase, words)), transform(sequence(1, if(words = 0, 1, words)),
        k -> struct(substring_index(phrase, ' ', k) as phrase, k as words)))"""
    )
    counts = edges.select("lang", "c", F.inline(within)).groupBy("lang", "phrase", "words").agg(F.sum("c").alias("f"))
    return counts.where((F.col("f") >= min_count) | (F.col("words") == 0))


def _part(phrase: str, words: Column) -> Column:
    """The first words of a phrase, or with a negative number the last ones."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), words)


def absorbed(counts: DataFrame) -> DataFrame:
    """(lang, phrase) of nodes whose whole flow goes on along, or comes from, one edge: they occur within it only.

    A phrase that lies in a longer one just as often lies in one that is a word
    longer, too, so one step tells.
    """
    longer = counts.where("words > 1")
    sides = F.explode(F.array(_part("phrase", F.col("words") - 1), _part("phrase", F.lit(1) - F.col("words"))))
    within = longer.select("lang", "f", sides.alias("phrase"))
    return within.groupBy("lang", "phrase").agg(F.max("f").alias("f")).join(counts, ["lang", "phrase", "f"]).select("lang", "phrase")


def unary_paths(counts: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, path, place) of the longest phrases: the first edge of the compacted path, and the place on it from 0.

    Two edges follow each other on a path if the node between them passes all it
    gets: both edges occur as often as the node. Predecessors are doubled, so a
    path of n words takes log2(n) rounds. No path is a ring, as every piece ends.
    """
    edges = counts.where(F.col("words") == longest).select("lang", "phrase", "f")
    nodes = counts.where(F.col("words") == longest - 1).select("lang", F.col("phrase").alias("node"), "f")
    leaving = edges.select("lang", "f", "phrase", _part("phrase", F.lit(longest - 1)).alias("node"))
    coming = edges.select("lang", "f", F.col("phrase").alias("before"), _part("phrase", F.lit(1 - longest)).alias("node"))
    links = leaving.join(nodes, ["lang", "node", "f"]).join(coming, ["lang", "node", "f"])
    state = edges.join(links.select("lang", "phrase", "before"), ["lang", "phrase"], "left").select(
        "lang", "phrase", F.coalesce("before", "phrase").alias("path"), F.col("before").isNotNull().cast("long").alias("place")
    )
    state, going = stored(state, "phrase-paths"), True
    while going:
        ahead = state.select("lang", F.col("phrase").alias("path"), F.col("path").alias("on"), F.col("place").alias("more"))
        moved = state.join(ahead, ["lang", "path"])
        state = stored(moved.select("lang", "phrase", F.col("on").alias("path"), (F.col("place") + F.col("more")).alias("place"), "more"), "phrase-paths")
        going = not state.where("more > 0").isEmpty()
        state = state.drop("more")
    return state


def collocations(
    docs: DataFrame,
    min_count: int = 100,
    longest: int = 5,
    top: int | None = 2000,
    map_bits: int = MAP_BITS,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The best-scored phrases of 2 to `longest` words of every language.

    Texts are lower-cased (A-Z), cut into pieces at `. , ; : ! ?` and line ends, and these
    into words at spaces and tabs; everything is counted per language. A phrase that occurs
    a >= `min_count` times is a candidate. Cut after k words its parts occur l and r times
    and it scores floor(1000 * a * n / (l * r)), n being the language's words; the worst cut
    counts, the smallest k of equal ones. Candidates that lie within a longer one just as often
    are dropped. Columns: lang, rank (from 1; score, then a descending, then phrase by bytes), phrase,
    a, l, r, n, score, path and place (`unary_paths`; null for shorter phrases and those on no path).

    Null texts count as empty, null languages as `und`; an empty table, or one without frequent
    phrases, gives no rows; repeated rows count as often as they occur. `top` ranks of each language
    are returned, None for all. Arithmetic is exact: counts are added as longs and products are
    decimals of 38 digits. Texts of any length are taken whole. Other columns are not read.
    """
    texts = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), utf8(F.col(f"`{text_col}`")).alias("text")
    )
    short = frequent_map(texts, min_count, map_bits)
    edges = weighted_edges(texts, short, longer_map(texts, short, min_count, longest, map_bits), longest)
    counts = stored(phrase_counts(edges, min_count, longest), "phrase-counts")
    candidates = counts.where("words > 1").join(absorbed(counts), ["lang", "phrase"], "left_anti")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumns({"one": _part("phrase", F.col("k")), "two": _part("phrase", F.col("k") - F.col("words"))})
    part = counts.where("words > 0").select("lang", F.col("phrase").alias("one"), F.col("f").alias("l"))
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    cuts = (
        cuts.join(part, ["lang", "one"]).join(part.toDF("lang", "two", "r"), ["lang", "two"]).join(totals, "lang")
    )
    big = "decimal(19, 0)"
    score = F.expr(f"(1000 * cast(a as {big}) * cast(n as {big})) div (cast(l as {big}) * cast(r as {big}))")
    worst = (
        cuts.withColumn("score", score)
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = worst.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    found = ranked.join(unary_paths(counts, longest), ["lang", "phrase"], "left")
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path", "place")
