"""Hierarchical multi-length packing of tokenized documents.

Windows of several sizes, powers of two, form the tiers. A document is cut into
whole windows of the largest size; what is left, like every shorter document,
goes to the smallest tier that holds it. The tiers are packed from the longest:
each window takes a document of its own tier, then the longest documents of
shorter tiers that fit, and in the end a part cut off one, so it is exactly full
and needs no padding. Sequences of one size are dealt to training steps of equal
tokens, and so that the steps' attention work is about equal.

Each task packs the documents it reads, block by block; texts and ids are never
shuffled, and a task holds one block and one text.
"""

from __future__ import annotations

import functools
import json
import os
import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewash.llm.common import slices, utf8

#: Window sizes; powers of two, the largest is what other sequences would be padded to.
TIERS = (256, 512, 1024, 2048)
#: Bytes of an id in the pieces.
_ID = 4
#: Steps of one size that are filled together.
_STEPS_AT_ONCE = 4
#: A space between two characters that are no white space: both sides are tokenized on their own.
_SEAM = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: how byte-level tokenizers cut a text into words.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the fast encoder is not given: characters outside the oldest blocks, which libraries may class
#: differently, and words so long that their merges take long.
_ODD = re.compile(r"[^\x00-\x1b\x20-\x7e\xa1-\u017f\u2010-\u2027\u2030-\u205e\u20ac]")
_GAP = re.compile(r"\s{500}")
_LONG_WORD = 500
#: Characters of a long text looked at in one go, and words remembered.
_SPAN = 1 << 20
_REMEMBERED = 200_000


def _byte_of() -> dict[str, int]:
    """Bytes by the characters that stand for them in byte-level vocabularies: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def fast_encoding(path: str) -> tiktoken.Encoding | None:
    """The tokenizer's own merges in an encoder that is some four times faster; None unless they mean the same.

    They do if words are cut by the usual pattern and each merge makes the next id.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or cut.get("type") != "ByteLevel":
        return None
    if cut.get("add_prefix_space") or not cut.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocab, byte = model["vocab"], _byte_of()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get("".join(m)) != 256 + i for i, m in enumerate(merges)):
        return None
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Ids:
    """Ids of texts as little-endian 32-bit integers, as the tokenizer gives them for the whole text.

    For tokenizers whose pre-tokens begin with the space before a word, as byte-level
    ones do. Between seams, runs of plain words go to the fast encoder with the same
    merges; other words go to the tokenizer itself once and are remembered, in two generations.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are what is parallel
        self._tokenizer, self._fast = Tokenizer.from_file(path), fast_encoding(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _words(self, words: list[str]) -> bytes:
        """Ids of words that each follow a space."""
        known = self._new
        unknown = [w for w in set(words) if w not in known]
        if unknown:
            if len(known) + len(unknown) > _REMEMBERED:
                self._old, self._new = known, {w: known[w] for w in set(words) if w in known}
                known = self._new
            fresh = []
            for w in unknown:
                held = self._old.get(w)
                if held is None:
                    fresh.append(w)
                else:
                    known[w] = held
            for at in range(0, len(fresh), 10_000):
                part = fresh[at : at + 10_000]
                known.update(zip(part, self._encode([" " + w for w in part]), strict=True))
        return b"".join(map(known.__getitem__, words))

    def _plain(self, text: str) -> bool:
        """Whether the fast encoder may take it."""
        if self._fast is None or _ODD.search(text) or any(x in text for x in self._special):
            return False
        return len(text) < _LONG_WORD or (max(map(len, text.split()), default=0) < _LONG_WORD and not _GAP.search(text))

    def _fast_ids(self, text: str) -> bytes:
        return self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def of(self, text: str) -> Iterator[bytes]:
        """The text's ids in parts, so that a very long text is never held as a whole in words."""
        start = 0
        while start < len(text):
            seam = _SEAM.search(text, start + _SPAN) if start + _SPAN < len(text) else None
            end = seam.start() if seam else len(text)
            span = text[start:end]
            if self._plain(span):
                yield self._fast_ids(span)
            else:
                words = _SEAM.split(span)
                if start:  # begins with the space of the seam before
                    words[0] = words[0][1:]
                else:
                    yield self._encode([words.pop(0)])[0]
                for plain, run in groupby(words, self._plain):
                    yield self._fast_ids(" " + " ".join(run)) if plain else self._words(list(run))
            start = end


@functools.cache
def shared_ids(path: str) -> Ids:
    """The encoder that the tasks of one worker share, with what it remembers."""
    return Ids(path)


@dataclass
class _Document:
    key: object
    tokens: int = 0


@dataclass(order=True)
class _Piece:
    """A run of a document's ids that nothing has been placed of."""

    length: int
    place: int  # order of arrival, for ties
    document: _Document = field(compare=False)
    start: int = field(compare=False)
    ids: bytes = field(compare=False)

    def cut(self, length: int) -> tuple[_Piece, _Piece]:
        head = _Piece(length, self.place, self.document, self.start, self.ids[: length * _ID])
        tail = _Piece(self.length - length, self.place, self.document, self.start + length, self.ids[length * _ID :])
        return head, tail


def pack_block(pieces: list[_Piece], tiers: tuple[int, ...]) -> tuple[list[tuple[int, list[_Piece]]], list[_Piece]]:
    """Full windows (size, pieces) of a block, and the pieces left: fewer tokens than one window of the largest size."""
    full: list[tuple[int, list[_Piece]]] = []
    shorter = sorted(pieces)
    for size, below in zip(reversed(tiers), [*reversed(tiers[:-1]), 0], strict=True):
        # The tier's own documents, the longest first; the others stay sorted by length.
        own = shorter[bisect_right(shorter, below, key=lambda p: p.length) :]
        del shorter[len(shorter) - len(own) :]
        while own:
            window = [own.pop()]
            gap = size - window[0].length
            while gap and (shorter or own):
                at = bisect_right(shorter, gap, key=lambda p: p.length)
                if at:  # the longest of a shorter tier that fits
                    taken = shorter.pop(at - 1)
                elif own and own[0].length <= gap:  # the lowest tier holds several of its own
                    taken = own.pop(bisect_right(own, gap, key=lambda p: p.length) - 1)
                else:  # a part of the shortest that is longer than the gap
                    taken, rest = (shorter.pop(0) if shorter else own.pop(0)).cut(gap)
                    insort(own if rest.length > below else shorter, rest)
                window.append(taken)
                gap -= taken.length
            if gap:
                shorter.extend(window)
                shorter.sort()
                return full, shorter
            full.append((size, window))
    return full, shorter


def powers_of_two(pieces: list[_Piece], largest: int) -> Iterator[tuple[int, list[_Piece]]]:
    """The last pieces of a task as full windows of falling powers of two."""
    left, queue = sum(p.length for p in pieces), sorted(pieces, reverse=True)
    while left:
        size = min(largest, 1 << left.bit_length() - 1)
        window, gap = [], size
        while gap:
            piece = queue.pop(0)
            if piece.length > gap:
                piece, rest = piece.cut(gap)
                queue.insert(0, rest)
            window.append(piece)
            gap -= piece.length
        yield size, window
        left -= size


class _Steps:
    """Deals the sequences of each size to steps of equal tokens and about equal attention work."""

    def __init__(self, step_tokens: int) -> None:
        self.step_tokens, self.next = step_tokens, 0
        self.waiting: dict[int, list[tuple[int, int, list]]] = {}

    def add(self, size: int, sequence: int, rows: list) -> Iterator[tuple[int, list]]:
        work = sum(r[2] * r[2] for r in rows)
        waiting = self.waiting.setdefault(size, [])
        waiting.append((work, sequence, rows))
        if len(waiting) * size >= _STEPS_AT_ONCE * self.step_tokens:
            yield from self._deal(size)

    def rest(self) -> Iterator[tuple[int, list]]:
        for size in sorted(self.waiting):
            yield from self._deal(size)

    def _deal(self, size: int) -> Iterator[tuple[int, list]]:
        """Full steps, and a last one of what is left."""
        waiting, each = self.waiting[size], max(1, self.step_tokens // size)
        steps = len(waiting) // each
        # To and fro over the steps, the most work first.
        for place, (_, _, rows) in enumerate(sorted(waiting[: steps * each], key=lambda x: (-x[0], x[1]))):
            turn, at = divmod(place, steps)
            yield self.next + (at if turn % 2 == 0 else steps - 1 - at), rows
        for _, _, rows in waiting[steps * each :]:
            yield self.next + steps, rows
        self.next += steps + (len(waiting) > steps * each)
        self.waiting[size] = []


class Packer:
    """Packs documents in order of arrival; what it returns is rows (key, start, length, ids, tokens, sequence, offset, size, step)."""

    def __init__(self, tiers: tuple[int, ...], block_tokens: int, step_tokens: int, first: int) -> None:
        self.tiers, self.block_tokens, self.first = tiers, block_tokens, first
        self.pool: list[_Piece] = []
        self.held = self.sequence = self.place = 0
        self.steps = _Steps(step_tokens)
        self.out: list[tuple] = []

    def add(self, key: object, parts: Iterator[bytes]) -> None:
        document, start, buffer = _Document(key), 0, b""
        whole = self.tiers[-1]
        windows = []
        for part in parts:
            buffer += part
            at = 0
            while len(buffer) - at >= whole * _ID:
                windows.append(_Piece(whole, self.place, document, start, buffer[at : at + whole * _ID]))
                start, at = start + whole, at + whole * _ID
            buffer = buffer[at:]
        document.tokens = start + len(buffer) // _ID
        for window in windows:
            self._sequence(whole, [window])
        if buffer:
            self.pool.append(_Piece(len(buffer) // _ID, self.place, document, start, buffer))
            self.held += len(buffer) // _ID
        self.place += 1
        if self.held >= self.block_tokens:
            full, self.pool = pack_block(self.pool, self.tiers)
            self.held = sum(p.length for p in self.pool)
            for size, window in full:
                self._sequence(size, window)

    def end(self) -> None:
        full, rest = pack_block(self.pool, self.tiers)
        for size, window in [*full, *powers_of_two(rest, self.tiers[-1])]:
            self._sequence(size, window)
        self._stepped(self.steps.rest())
        self.pool = []

    def _sequence(self, size: int, window: list[_Piece]) -> None:
        rows, offset = [], 0
        for p in window:
            rows.append((p.document.key, p.start, p.length, p.ids, p.document.tokens, self.first + self.sequence, offset, size))
            offset += p.length
        self._stepped(self.steps.add(size, self.sequence, rows))
        self.sequence += 1

    def _stepped(self, dealt: Iterator[tuple[int, list]]) -> None:
        for step, rows in dealt:
            self.out.extend((*row, self.first + step) for row in rows)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    block_tokens: int = 1 << 20,
    step_tokens: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents in sequences: where each piece lies, and its ids.

    A document is the tokenizer's ids of its text, without special tokens added,
    then `end_id`. Columns: doc_id (of its own type), start (ids of the document before
    the piece), length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset (in the sequence), tier (the sequence's size) and step_id (the training step;
    its sequences have one size). Every id lies in one piece. All sequences are exactly full;
    what is left at the end of a task goes to windows of falling powers of two, so nothing
    is padded. Sequence and step ids are unique in the table, not gapless.

    Null texts count as empty and give `end_id` alone; null ids and repeated rows are
    documents like any other; an empty table gives no rows. Texts of any length are
    tokenized as a whole, in parts. Other columns are not read. A task that is run
    again on the same rows gives the same pieces.
    """
    tiers = tuple(sorted(tiers))
    if not tiers or any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("Window sizes are powers of two.")
    key = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"doc_id {key}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_id long"
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared_ids(tokenizer)
        packer = Packer(tiers, block_tokens, step_tokens, TaskContext.get().partitionId() << 33)
        ending = end_id.to_bytes(_ID, "little")
        kinds: list[pa.DataType] = []

        def rows() -> Iterator[pa.RecordBatch]:
            held = packer.out
            for at in range(0, len(held), 4096):
                columns = zip(*held[at : at + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            packer.out = []

        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_id"]
        for batch in slices(batches, 1):
            long = pa.int64()
            kinds = [batch.column(0).type, long, long, pa.binary(), long, long, long, pa.int32(), long]
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):

                def parts(text: bytes = text) -> Iterator[bytes]:
                    yield from ids.of(text.decode("utf-8", "replace"))
                    yield ending

                packer.add(name, parts())
            if len(packer.out) >= 4096:
                yield from rows()
        packer.end()
        yield from rows()

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), utf8(F.col(f"`{text_col}`")).alias("text")).mapInArrow(packed, schema)
