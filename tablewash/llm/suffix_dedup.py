"""Suffix-array dedup: bytes covered by long strings that occur elsewhere too.

1. Candidates. Every string of full length has an anchor, the smallest hash of
   its 64-byte substrings; equal strings have equal anchors. Only strings whose
   anchor occurs at two places can repeat, so only the text they cover (the
   segments) goes on. Equal whole texts are settled by their digests and stand
   for each other.
2. Suffix array. Segments are cut into phrases that begin where the content
   says so, whatever stands before. Phrases are sorted and named, and the suffixes that
   begin with a phrase are sorted by the distributed difference cover.
3. Adjacent prefixes. A suffix whose first bytes are those of its neighbour in
   the order repeats; as the order is that of the bytes, no other suffix needs
   to be looked at.
4. Remaining strings, which begin within a phrase, are what comes before a
   phrase and a prefix of that phrase's suffix. They are compared only where
   the suffix repeats far enough and the phrase before does not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewash.llm.common import discard, free_names, map_rows, quoted, release, slices, stored, utf8, written
from tablewash.llm.difference_cover import suffix_order

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Bytes of an anchor.
_ANCHOR = 64
#: Strings are looked at in blocks of so many starting places.
_BLOCK = 1 << 20
#: Short texts are hashed together until they hold so many bytes.
_PART = 1 << 17


def _mixed(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    found = left * _MIX[salt] + right * _MIX[salt + 1]
    found ^= found >> np.uint64(31)
    found *= _MIX[salt + 2]
    return found ^ found >> np.uint64(29)


class Prefixes:
    """Hashes of all substrings of one length, from those of half the length; lengths from 8."""

    def __init__(self, text: bytes, salt: int = 0) -> None:
        self.size = len(text)
        self.salt = salt
        words = np.ndarray((max(0, len(text) - 7),), "<u8", text, 0, (1,)) if len(text) >= 8 else np.empty(0, "<u8")
        self.raw = words.astype(np.uint64)
        self.found = {8: _mixed(self.raw, self.raw >> np.uint64(32), salt)}

    def of(self, length: int) -> np.ndarray:
        if length not in self.found:
            half = 8
            while half * 2 < length:
                half *= 2
            below, count = self.of(half), max(0, self.size - length + 1)
            self.found[length] = _mixed(below[:count], below[length - half : length - half + count], self.salt)
        return self.found[length]

    def at(self, length: int, places: np.ndarray) -> np.ndarray:
        """The same for some places; for few of them no others are hashed."""
        if length in self.found:
            return self.found[length][places]
        half = 8
        while half * 2 < length:
            half *= 2
        ahead = places + (length - half)
        if places.size * 4 >= self.size:
            below = self.of(half)
            return _mixed(below[places], below[ahead], self.salt)
        both = self.at(half, np.concatenate([places, ahead]))
        return _mixed(both[: places.size], both[places.size :], self.salt)


class _Joined:
    """Texts one after another, to be hashed together; what crosses from one into the next is masked."""

    def __init__(self, texts: list[bytes]) -> None:
        self.text = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes

    def holds(self, length: int) -> np.ndarray:
        """For each place, whether a string of `length` from there on lies within one text."""
        edge = np.zeros(len(self.text) + 1, np.int8)
        long = self.end - self.start >= length
        edge[self.start[long]] = 1
        edge[self.end[long] - length + 1] = -1
        return np.cumsum(edge[:-1], dtype=np.int8) > 0

    def rows(self, places: np.ndarray) -> np.ndarray:
        """Which text each place belongs to."""
        return np.searchsorted(self.end, places, "right")


def _groups(texts: Iterable[bytes]) -> Iterator[tuple[int, _Joined]]:
    """Texts joined until they hold _PART bytes, with the number of the first of them."""
    held: list[bytes] = []
    first = size = 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= _PART:
            yield first, _Joined(held)
            first, held, size = first + len(held), [], 0
    if held:
        yield first, _Joined(held)


def _cut_groups(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, _Joined]]:
    """Row and place of the blocks of all texts, and the blocks joined."""
    rows, places = [], []

    def parts() -> Iterator[bytes]:
        for row, text in enumerate(texts):
            for at, part in _blocks(text, length):
                rows.append(row)
                places.append(at)
                yield part

    for first, joined in _groups(parts()):
        own = slice(first, first + joined.end.size)
        yield np.array(rows[own], np.int64), np.array(places[own], np.int64), joined


def _listed(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The fields of a column of lists of structs: which row each entry belongs to, and the values."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(sizes.size), sizes), [x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten()]


def _together(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the runs, and which run each belongs to."""
    size = last - first + 1
    run = np.repeat(np.arange(size.size), size)
    return np.arange(run.size) - np.repeat(np.cumsum(size) - size, size) + first[run], run


def _extreme(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The smallest or largest of every `width` neighbours."""
    done, found = 1, values
    while done < width:
        step = min(done, width - done)
        found = pick(found[:-step], found[step:])
        done += step
    return found


def _blocks(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Parts of a text that hold at most _BLOCK starting places of strings of `length`, each place once."""
    for start in range(0, len(text) - length + 1, _BLOCK):
        yield start, text[start : start + _BLOCK + length - 1]


def _least(h: np.ndarray, joined: _Joined, length: int) -> np.ndarray:
    """For each string of `length`, the smallest hash of its substrings; zero for what is not within one text."""
    least = _extreme(h, length - _ANCHOR + 1, np.minimum)
    least[~joined.holds(length)[: least.size]] = 0
    return least


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places and hashes of all anchors of some texts."""
    rows, places, hashes = [], [], []
    for row, at, joined in _cut_groups(texts, length):
        h = Prefixes(joined.text).of(_ANCHOR)
        width = length - _ANCHOR + 1
        pad = np.zeros(width - 1, np.uint64)
        chosen = np.flatnonzero(_extreme(np.concatenate([pad, _least(h, joined, length), pad]), width, np.maximum) == h)
        own = joined.rows(chosen)
        rows.append(row[own])
        places.append(chosen - joined.start[own] + at[own])
        hashes.append(h[chosen])
    row, place, found = _together(rows), _together(places), _together(hashes, np.uint64)
    order = np.lexsort((place, row))
    row, place, found = row[order], place[order], found[order]
    new = np.ones(row.size, bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
    return row[new], place[new], found[new]


def _spacing(length: int) -> int:
    """Phrases are longer than this: nine of them hold a string of `length` and half as much."""
    return length // 6


def _look(length: int) -> int:
    """So many bytes, from its first on, decide whether a phrase begins."""
    return 2 * _spacing(length) + 8


def _depth(length: int) -> int:
    """How far suffixes are sorted: what nine phrases hold at least."""
    return 9 * (_spacing(length) + 1)


def phrase_starts(hashes: Prefixes, joined: _Joined, length: int) -> np.ndarray:
    """Places where a phrase begins: so far before an 8-byte hash that is smaller than all around it."""
    h, side = hashes.found[8], _spacing(length)
    if h.size <= 2 * side:
        return np.empty(0, np.int64)
    around = _extreme(h, side, np.minimum)
    middle = h[side : h.size - side]
    found = (middle < around[: middle.size]) & (middle < around[side + 1 : side + 1 + middle.size])
    return np.flatnonzero(found & joined.holds(_look(length))[: middle.size])


#: How far before a phrase a remaining string begins: from, and below.
def _ranges(length: int) -> list[tuple[int, int]]:
    far = length - _look(length) + 1
    return [(a, min(b, far)) for a, b in ((1, 64), (64, 128), (128, 256), (256, far)) if a < min(b, far)]


def _rows(columns: list[np.ndarray | list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k, from_pandas=False) for c, k in zip(columns, kinds, strict=True)], names)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _anchor_rows(length: int):
    """h, low, high (the smallest and largest name of its places), t1, t2: one row for each anchor of a text, however often it stands there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            t1, t2 = (batch.column(i).to_numpy() for i in (0, 1))
            row, place, h = anchors(batch.column(2).to_pylist(), length)
            k = _signed(_mixed(t1[row].view(np.uint64) ^ t2[row].view(np.uint64), place.astype(np.uint64), 0))
            order = np.lexsort((h, row))
            row, h, k = row[order], h[order], k[order]
            new = np.ones(row.size, bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            first = np.flatnonzero(new)
            low, high = (pick.reduceat(k, first) for pick in (np.minimum, np.maximum))
            own = row[first]
            yield _rows([_signed(h[first]), low, high, t1[own], t2[own]], ["h", "low", "high", "t1", "t2"], [pa.int64()] * 5)

    return cut


def _segment_rows(length: int):
    """seq, start, bytes of the parts of a text whose strings have a marked anchor."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            seq, marks = batch.column(0).to_numpy(), batch.column(2)
            # An anchor of one text that is marked in another is marked here too.
            known = np.unique(marks.flatten().to_numpy().view(np.uint64))
            seqs, starts, parts = [], [], []
            for row, at, joined in _cut_groups(batch.column(1).to_pylist(), length):
                least = _least(Prefixes(joined.text).of(_ANCHOR), joined, length)
                turn = np.flatnonzero(np.diff(least, prepend=~least[:1]))
                wanted = np.isin(least[turn], known) & (least[turn] != 0)
                edge = np.diff(np.concatenate([[0], wanted.view(np.int8), [0]]))
                bounds = np.append(turn, least.size)
                first, end = bounds[edge == 1], bounds[edge == -1]
                own = joined.rows(first)
                seqs.append(seq[row[own]])
                starts.append(at[own] + first - joined.start[own])
                parts.extend(joined.text[a : b + length - 1] for a, b in zip(first.tolist(), end.tolist(), strict=True))
            seqs, starts = _together(seqs), _together(starts)
            yield _rows([seqs, starts, parts], ["seq", "start", "bytes"], [pa.int64(), pa.int64(), pa.binary()])

    return cut


_PHRASE_SCHEMA = "sid long, idx long, pos long, gap long, before long, n1 long, n2 long, whole long, deep long, "


def _phrase_rows(length: int):
    """One row for each phrase of a segment.

    pos in the segment; gap to the next phrase (to the end for the last);
    before: starting places before it that belong to no earlier phrase; n1, n2
    name the phrase; whole: hash of the string that begins here; deep: of all
    strings that begin in the phrase; c0.. of the prefixes that strings
    beginning in the ranges before share. Hashes of what passes the segment's
    end are null.
    """
    spans = _ranges(length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out: list[list[np.ndarray]] = [[] for _ in range(9 + len(spans))]
            nulls: list[list[np.ndarray]] = [[] for _ in range(2 + len(spans))]
            phrases: list[bytes] = []
            sids = batch.column(0).to_numpy()
            for row, joined in _groups(batch.column(1).to_pylist()):
                hashes, other = Prefixes(joined.text), Prefixes(joined.text, 1)
                at = phrase_starts(hashes, joined, length)
                if not at.size:
                    continue
                own = joined.rows(at)
                begin, end = joined.start[own], joined.end[own]
                new = np.ones(at.size, bool)
                new[1:] = own[1:] != own[:-1]
                head = np.flatnonzero(new)
                idx = np.arange(at.size) - np.repeat(head, np.diff(np.append(head, at.size)))
                ends = np.append(new[1:], True)
                follow = np.where(ends, end, np.append(at[1:], 0))
                gap = follow - at
                before = np.where(new, at - begin, np.diff(at, prepend=0) - 1)
                owned = end - length + 1
                last = np.minimum(follow - 1, owned - 1)
                whole = hashes.at(length, np.minimum(at, owned - 1))
                deep = _mixed(whole, hashes.at(length, last), 1) ^ gap.astype(np.uint64)
                # The bytes a phrase is named by go on to what begins the next one, so that none begins another.
                tail = np.where(ends, end, np.append(at[1:] + _look(length), 0))
                names = [joined.text[a:b] for a, b in zip(at.tolist(), tail.tolist(), strict=True)]
                phrases.extend(names)
                digests = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in names), np.int64).reshape(-1, 2)
                cores = []
                for _, high in spans:
                    size = length - high + 1
                    cores.append((other.at(size, np.minimum(at, end - size)), at + size > end))
                columns = [sids[row + own], idx, at - begin, gap, before, digests[:, 0], digests[:, 1], _signed(whole), _signed(deep)]
                for target, c in zip(out, [*columns, *(_signed(c) for c, _ in cores)], strict=True):
                    target.append(c)
                short = follow - 1 + length > end
                for target, c in zip(nulls, [at >= owned, short | (gap + length - 1 > _depth(length)), *(c for _, c in cores)], strict=True):
                    target.append(c)
            join = [_together(c) for c in out]
            gone = [_together(c, bool) for c in nulls]
            arrays = [pa.array(c) for c in join[:7]] + [pa.array(c, mask=g) for c, g in zip(join[7:], gone, strict=True)]
            names = _PHRASE_SCHEMA.replace(" long", "").replace(" ", "").strip(",").split(",")
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(phrases, pa.binary())], [*names, *(f"c{i}" for i in range(len(spans))), "phrase"]
            )

    return cut


def _bare_rows(length: int):
    """a, b, n, sid, place of strings in which no phrase begins: each once a segment, n how often it occurs there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sids, parts = batch.column(0).to_numpy(), []
            for row, joined in _groups(batch.column(1).to_pylist()):
                hashes = Prefixes(joined.text)
                at = _bare(hashes, joined, length)
                if at.size:
                    own = joined.rows(at)
                    parts.append((sids[row + own], at - joined.start[own], hashes.at(length, at), Prefixes(joined.text, 1).at(length, at)))
            rows = [np.empty(0, np.int64)] * 5
            if parts:
                sid, at, a, b = (np.concatenate([p[i] for p in parts]) for i in range(4))
                order = np.lexsort((at, b, a, sid))
                sid, at, a, b = sid[order], at[order], a[order], b[order]
                new = np.ones(sid.size, bool)
                new[1:] = (sid[1:] != sid[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, sid.size))
                rows = [_signed(a[first]), _signed(b[first]), times, sid[first], at[first]]
            yield _rows(rows, ["a", "b", "n", "sid", "place"], [pa.int64()] * 5)

    return cut


def _bare(hashes: Prefixes, joined: _Joined, length: int) -> np.ndarray:
    """Starting places of strings in which no phrase begins."""
    edge = np.zeros(len(joined.text) + 1, np.int64)
    at = phrase_starts(hashes, joined, length)
    np.add.at(edge, np.maximum(at - (length - _look(length)), joined.start[joined.rows(at)]), 1)
    np.add.at(edge, at + 1, -1)
    return np.flatnonzero((np.cumsum(edge[:-1]) == 0) & joined.holds(length))


def _context_rows(length: int):
    """For the asked (pos, range): the strings of that range as one context (f1, f2), from its first to its last."""
    lows, highs = np.array(_ranges(length), np.int64).reshape(-1, 2).T

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sids, (row, (pos, before, r, c)) = batch.column(0).to_numpy(), _listed(batch.column(2))
            texts = batch.column(1).to_pylist()
            owned = np.array([len(t) - length + 1 for t in texts], np.int64)[row]
            first, last = pos - np.minimum(highs[r] - 1, before), np.minimum(pos - lows[r], owned - 1)
            row, pos, r, c, first, last = (x[first <= last] for x in (row, pos, r, c, first, last))
            ends: list[list[np.ndarray]] = [[] for _ in range(4)]
            for start, joined in _groups(texts):
                own = slice(*np.searchsorted(row, [start, start + joined.end.size]))
                at = joined.start[row[own] - start]
                for salt in (0, 1):
                    hashes = Prefixes(joined.text, salt)
                    ends[2 * salt].append(hashes.at(length, at + first[own]))
                    ends[2 * salt + 1].append(hashes.at(length, at + last[own]))
            a, a_last, b, b_last = (_together(e, np.uint64) for e in ends)
            x, y = ((v.astype(np.uint64) * _MIX[4]) for v in (last - first, pos - first))
            f1, f2 = _mixed(a ^ y, a_last ^ x, 1), _mixed(b ^ x, b_last ^ y, 2)
            out = [sids[row], r, c, _signed(f1), _signed(f2), first, last]
            yield _rows(out, ["sid", "r", "c", "f1", "f2", "first", "last"], [pa.int64()] * 7)

    return cut


def _string_rows(length: int):
    """a, b, n, sid, place of each string of the given (first, last, n)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            sids, (row, (first, last, n)) = batch.column(0).to_numpy(), _listed(batch.column(2))
            for start, joined in _groups(batch.column(1).to_pylist()):
                own = slice(*np.searchsorted(row, [start, start + joined.end.size]))
                at, run = _spread(first[own], last[own])
                seg = row[own][run]
                place = at + joined.start[seg - start]
                a, b = (Prefixes(joined.text, salt).at(length, place) for salt in (0, 1))
                for c, v in zip(out, (_signed(a), _signed(b), n[own][run], sids[seg], at), strict=True):
                    c.append(v)
            out = [_together(c) for c in out]
            yield _rows(out, ["a", "b", "n", "sid", "place"], [pa.int64()] * 5)

    return cut


def _bare_places(length: int):
    """sid, first, last of the places where one of the given strings without a phrase stands."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sids, firsts, lasts = [], [], []
            for sid, text, given in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                hashes = Prefixes(text)
                at = _bare(hashes, _Joined([text]), length)
                at = at[np.isin(hashes.at(length, at), given.values.to_numpy().view(np.uint64))]
                cuts = np.flatnonzero(np.diff(at) > 1)
                for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), at.size - 1], strict=True) if at.size else ():
                    sids.append(sid)
                    firsts.append(int(at[a]))
                    lasts.append(int(at[b]))
            yield _rows([sids, firsts, lasts], ["sid", "first", "last"], [pa.int64()] * 3)

    return cut


def _per_segment(segments: DataFrame, rows: DataFrame, what: str) -> DataFrame:
    """sid, bytes and the rows of each segment that has any, as an array."""
    listed = rows.groupBy(F.col("sid").alias("_sid")).agg(F.collect_list(what if "," not in what else F.struct(*what.split(","))).alias("given"))
    return segments.join(listed, F.col("sid") == F.col("_sid")).select("sid", "bytes", "given")


def _neighbours(order: DataFrame, flags: list[str], width: int = 65_536) -> DataFrame:
    """Rows (rank from 0 without gaps) with same_<flag>: whether the value equals that of a neighbour in the order.

    Windows hold `width` rows and one more on either side.
    """
    homes = F.array_distinct(F.array(*(F.floor((F.greatest(F.col("rank") + d, F.lit(0))) / width) for d in (-1, 0, 1))))
    spread = order.withColumn("_home", F.explode(homes))
    near = Window.partitionBy("_home").orderBy("rank")
    same = [
        (F.coalesce(F.col(f) == F.lag(f).over(near), F.lit(False)) | F.coalesce(F.col(f) == F.lead(f).over(near), F.lit(False))).alias(f"same_{f}")
        for f in flags
    ]
    return spread.select("*", *same).filter(F.col("_home") == F.floor(F.col("rank") / width)).drop("_home")


def repeated_strings(segments: DataFrame, length: int) -> DataFrame:
    """sid, first, last: runs of starting places, in segments (sid, bytes), of strings that start elsewhere too."""
    spans = _ranges(length)
    since = written()
    cores = [f"c{i}" for i in range(len(spans))]
    schema = _PHRASE_SCHEMA + ", ".join(f"{c} long" for c in cores) + ", phrase binary"
    everything = stored(segments.select("sid", "bytes").mapInArrow(_phrase_rows(length), schema), "phrases")
    # Names in the order of the phrases' bytes.
    kinds = everything.groupBy(F.col("n1").alias("m1"), F.col("n2").alias("m2")).agg(F.min("phrase").alias("phrase"))
    names = stored(kinds.orderBy("phrase").withColumn("sym", F.monotonically_increasing_id()).select("m1", "m2", "sym"), "phrase-names")
    phrases = everything.drop("phrase")
    named = phrases.join(names, (F.col("n1") == F.col("m1")) & (F.col("n2") == F.col("m2")))
    ranks = suffix_order(
        named.select(F.col("sid").alias("seq"), F.col("idx").alias("pos"), "sym", F.col("gap").alias("size")), _depth(length)
    )
    ranks = ranks.select(F.col("seq").alias("_seq"), F.col("pos").alias("_idx"), "rank")
    order = phrases.join(ranks, (F.col("sid") == F.col("_seq")) & (F.col("idx") == F.col("_idx")))
    flagged = stored(_neighbours(order, ["whole", "deep", *cores]), "flagged")
    discard(segments.sparkSession, since, flagged)
    runs = flagged.filter("same_deep or same_whole").select(
        "sid", F.col("pos").alias("first"), F.when(F.col("same_deep"), F.col("pos") + F.col("gap") - 1).otherwise(F.col("pos")).alias("last")
    )
    # Strings before a phrase: asked where the phrase before does not repeat to its end, compared with all that share
    # the prefix they have in common.
    along = Window.partitionBy("sid").orderBy("idx")
    options = F.filter(
        F.array(*(
            F.when(F.col(f"same_{c}") & (F.col("before") >= low), F.struct(F.lit(i).cast("long").alias("r"), F.col(c).alias("c")))
            for i, (c, (low, _)) in enumerate(zip(cores, spans, strict=True))
        )),
        lambda x: x.isNotNull(),
    )
    known = F.coalesce(F.lag("same_deep").over(along), F.lit(False))
    lined = flagged.select("sid", "pos", "before", known.alias("known"), options.alias("options"))
    members = lined.select("sid", "pos", "before", "known", F.explode("options").alias("x")).select("sid", "pos", "before", "known", "x.r", "x.c")
    members = stored(members, "members")
    open_ = members.filter("not known").select(F.col("r").alias("_r"), F.col("c").alias("_c")).distinct()
    asked = members.join(open_, (F.col("r") == F.col("_r")) & (F.col("c") == F.col("_c")))
    contexts = _per_segment(segments, asked, "pos,before,r,c").mapInArrow(
        _context_rows(length), "sid long, r long, c long, f1 long, f2 long, first long, last long"
    )
    contexts = stored(contexts, "contexts")
    kinds = contexts.groupBy("r", "c", "f1", "f2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("sid", "first", "last")).alias("one")
    )
    kinds = stored(kinds, "context-kinds")
    release(segments.sparkSession)
    # A context met twice repeats as a whole; else its strings are compared one by one with those of the others.
    often = kinds.filter("n > 1").select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("f1").alias("_1"), F.col("f2").alias("_2"))
    twice = contexts.join(often, (F.col("r") == F.col("_r")) & (F.col("c") == F.col("_c")) & (F.col("f1") == F.col("_1")) & (F.col("f2") == F.col("_2")))
    mixed = kinds.groupBy(F.col("r").alias("_r"), F.col("c").alias("_c")).agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    single = kinds.join(mixed, (F.col("r") == F.col("_r")) & (F.col("c") == F.col("_c"))).select("one.sid", "one.first", "one.last", "n")
    compared = _per_segment(segments, single, "first,last,n").mapInArrow(_string_rows(length), "a long, b long, n long, sid long, place long")
    compared = stored(compared, "strings")
    bare = stored(segments.select("sid", "bytes").mapInArrow(_bare_rows(length), "a long, b long, n long, sid long, place long"), "bare")

    def met(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.sum("n").alias("_n")).filter("_n > 1")
        return rows.join(found, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))

    places = met(compared).filter("n = 1").select("sid", F.col("place").alias("first"), F.col("place").alias("last"))
    bare_places = _per_segment(segments, met(bare).select("sid", "a"), "a").mapInArrow(_bare_places(length), "sid long, first long, last long")
    return runs.union(twice.select("sid", "first", "last")).union(places).union(bare_places)


def removal_runs(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t1, t2 (digests of the text), copied, runs (array of first, last) for rows that lose bytes."""
    since = written()
    text = utf8(F.col(text_col))
    t1, t2 = F.xxhash64(text).alias("t1"), F.xxhash64(F.concat(F.lit(b"2"), text)).alias("t2")
    long = docs.filter(F.octet_length(text) >= length).select(F.col(id_col).alias("doc_id"), t1, t2, text.alias("bytes"))
    digests = stored(long.select("doc_id", "t1", "t2"), "digests")
    texts = digests.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("own"))
    texts = stored(texts.withColumn("seq", F.monotonically_increasing_id()), "texts")
    found = stored(long.select("t1", "t2", "bytes").mapInArrow(_anchor_rows(length), "h long, low long, high long, t1 long, t2 long"), "anchors")
    spread = found.groupBy(F.col("h").alias("_h")).agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high")
    # Stored, so that the join is not bound to the aggregation's partitions and a common anchor's rows can be dealt out.
    spread = stored(spread.select("_h"), "spread")
    marked = found.join(spread, F.col("h") == F.col("_h")).groupBy(F.col("t1").alias("m1"), F.col("t2").alias("m2")).agg(F.collect_set("h").alias("marks"))
    chosen = texts.join(marked, (F.col("t1") == F.col("m1")) & (F.col("t2") == F.col("m2"))).select("seq", "m1", "m2", "own", "marks")
    chosen = stored(chosen, "chosen")
    release(docs.sparkSession)
    # One row stands for all with the same text.
    standing = long.join(chosen, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("t1") == F.col("m1")) & (F.col("t2") == F.col("m2")))
    cut = standing.select("seq", "bytes", "marks").mapInArrow(_segment_rows(length), "seq long, start long, bytes binary")
    segments = stored(cut.withColumn("sid", F.monotonically_increasing_id()), "segments-raw")
    # Rows that repeat id and text gave the same segments more than once.
    kept = segments.groupBy(F.col("seq").alias("_seq"), F.col("start").alias("_start")).agg(F.min("sid").alias("_one"))
    segments = stored(segments.join(kept, F.col("sid") == F.col("_one")).select("seq", "start", "bytes", "sid"), "segments")
    discard(docs.sparkSession, since, digests, texts, segments)
    runs = repeated_strings(segments, length).withColumnRenamed("sid", "_sid")
    origin = segments.select("seq", "start", "sid")
    runs = origin.join(runs, F.col("sid") == F.col("_sid")).groupBy(F.col("seq").alias("_seq")).agg(
        F.collect_list(F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))).alias("runs")
    )
    runs = stored(runs, "runs")
    discard(docs.sparkSession, since, digests, texts, runs)
    judged = texts.join(runs, F.col("seq") == F.col("_seq"), "left").filter("n > 1 or runs is not null")
    judged = judged.select(F.col("t1").alias("_1"), F.col("t2").alias("_2"), (F.col("n") > 1).alias("copied"), F.when(F.col("n") == 1, F.col("runs")).alias("runs"))
    rows = digests.distinct().join(judged, (F.col("t1") == F.col("_1")) & (F.col("t2") == F.col("_2")))
    removals = stored(rows.select("doc_id", "t1", "t2", "copied", "runs"), "removals")
    discard(docs.sparkSession, since, removals)
    return removals


def _run_arrays(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """The first and last places of each row's runs."""
    row, (first, last) = _listed(column)
    bounds = np.searchsorted(row, np.arange(len(column) + 1)).tolist()
    return [(first[a:b], last[a:b]) if a < b else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def kept_mask(size: int, copied: bool, runs: tuple[np.ndarray, np.ndarray] | None, length: int) -> np.ndarray:
    """Which bytes of a text stay."""
    if copied:
        return np.zeros(size, bool)
    edge = np.zeros(size + 1, np.int64)
    if runs:
        np.add.at(edge, runs[0], 1)
        np.add.at(edge, runs[1] + length, -1)
    return np.cumsum(edge[:-1]) == 0


def _joined(docs: DataFrame, length: int, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """The columns, then whether the whole text is a copy and its runs."""
    gone = removal_runs(docs, length, id_col, text_col)
    names = free_names(docs.columns, "gone_id", "gone_1", "gone_2", "gone_copied", "gone_runs")
    gone = gone.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "t1", "t2", "copied", "runs"), names, strict=True)))
    text, (own, one, two, *rest) = utf8(quoted(text_col)), names
    on = (
        quoted(id_col).eqNullSafe(F.col(own))
        & (F.xxhash64(text) == F.col(one))
        & (F.xxhash64(F.concat(F.lit(b"2"), text)) == F.col(two))
    )
    kept = [quoted(c) for c in columns]
    return docs.select(*kept).join(gone, on, "left").select(*kept, *rest)


def remove_repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every document.

    A byte goes if a string of `length` bytes over it also starts anywhere else,
    in the same text or another; strings never cross documents and are judged on
    the input. All occurrences go, the first too. Null and empty texts have no
    bytes. Strings are compared by their hashes: by 64 bits with a neighbour in
    the suffix order, by 128 bits otherwise. Rows may share ids and texts or have
    null ids: each row is a document of its own. Other columns of the input are
    neither read nor returned; an empty table gives an empty result.
    """
    joined = _joined(docs, length, id_col, text_col, [id_col, text_col])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out: list[list] = [[] for _ in range(5)]
            for text, copied, runs in zip(*(batch.column(i).to_pylist() for i in (1, 2)), _run_arrays(batch.column(3)), strict=True):
                text = text or b""
                rest, spans = text, 0
                if copied or runs:
                    keep = kept_mask(len(text), bool(copied), runs, length)
                    rest = np.frombuffer(text, np.uint8)[keep].tobytes()
                    spans = int(np.count_nonzero(np.diff(keep.view(np.int8), prepend=1) == -1))
                for c, v in zip(out, (len(text), len(text) - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(out, [pa.int64()] * 3 + [pa.string(), pa.binary()], strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    asked = joined.select(quoted(id_col), utf8(quoted(text_col)), *joined.columns[2:])
    return asked.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def whole_characters(text: bytes, keep: np.ndarray) -> bytes:
    """The kept bytes, with every character whole: one that would lose only some of its bytes stays."""
    raw = np.frombuffer(text, np.uint8)
    if keep.all() or not raw.size:
        return raw[keep].tobytes()
    starts = np.flatnonzero(raw & 0xC0 != 0x80)
    if not starts.size or starts[0]:
        starts = np.insert(starts, 0, 0)
    any_kept = np.logical_or.reduceat(keep, starts)
    return raw[np.repeat(any_kept, np.diff(np.append(starts, raw.size)))].tobytes()


def drop_repeated_bytes(docs: DataFrame, length: int = 400) -> DataFrame:
    """The documents with all their columns, texts without repeated strings; n_chars, if there, counts anew.

    A character stays if any of its bytes does, so that texts remain valid. No
    row goes, even if nothing of its text remains; null texts stay null.
    """
    columns = docs.columns
    joined = _joined(docs, length, "doc_id", "text", columns)
    at = columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = []
            runs_of = _run_arrays(batch.column(len(columns) + 1))
            for text, copied, runs in zip(*(batch.column(i).to_pylist() for i in (at, len(columns))), runs_of, strict=True):
                raw = (text or "").encode()
                changed = copied or runs
                texts.append(whole_characters(raw, kept_mask(len(raw), bool(copied), runs, length)).decode() if changed else text)
            arrays = list(batch.columns[: len(columns)])
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, columns)

    done = map_rows(joined, cut, docs.schema)
    if "n_chars" in columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return done.select(*map(quoted, columns))
