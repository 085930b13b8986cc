"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation of a text into pieces (greatest sum of the vocabulary's
scores) is found while the text streams by: only positions that a piece still
to come can start from stay open, and once the paths to all of them run through
one boundary, the ids before it are final and are given out.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tablewash.llm.common import map_texts

#: Fixed value: the mark that pieces hold in place of a space.
SPACE = "▁"
#: Fixed value: how far below the worst piece a character without a piece scores.
_UNKNOWN_PENALTY = 10.0
_CACHED_UNITS = 150_000
_CACHED_LENGTH = 64
#: The vocabulary goes to every executor: it may not be larger.
MAX_MODEL_BYTES = 64 << 20


class Vocabulary:
    """Pieces with ids and scores, read on the driver and shipped as plain values."""

    def __init__(self, pieces: list[tuple[str, float, str]], prefix: bool) -> None:
        self.prefix = prefix
        self.ids = {p: (i, s) for i, (p, s, kind) in enumerate(pieces) if kind == "normal"}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.unknown_id = next((i for i, (_, _, kind) in enumerate(pieces) if kind == "unknown"), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_score = min((s for _, s in self.ids.values()), default=0.0) - _UNKNOWN_PENALTY
        #: Pieces from their last character back: character -> (characters before, id or -1, score).
        self.backward: dict = {}
        for p, (i, score) in self.ids.items():
            level = self.backward
            for c in reversed(p[1:]):
                level = level.setdefault(c, ({}, -1, 0.0))[0]
            before = level.get(p[0], ({}, -1, 0.0))[0]
            level[p[0]] = (before, i, score)
        self.shown: dict[int, bytes] = {}
        for i, (p, _, kind) in enumerate(pieces):
            if kind == "normal":
                self.shown[i] = p.replace(SPACE, " ").encode()
            elif kind == "byte":
                self.shown[i] = bytes([int(p[3:5], 16)])
            else:
                self.shown[i] = " ⁇ ".encode() if kind == "unknown" else b""
        inner = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        #: No piece crosses these, so all paths meet there and the units between them are independent: before a
        #: run of space marks, around a line feed, between a letter and a mark of punctuation.
        words = all(a == SPACE for a, b in inner if b == SPACE)
        lines = all("\n" not in pair for pair in inner)
        letter = re.compile(r"[^\W\d_]").fullmatch
        after_letters = {b for a, b in inner if letter(a)}
        marks = {c for p in self.ids for c in p if not c.isalnum()} - after_letters - {SPACE, "\n", "_"}
        stops = re.escape("".join(sorted(marks)))
        if not words:
            self.units = "[^\n]+|\n" if lines else r"(?s).+"
        else:
            rest = f"[^{SPACE}" + ("\n]" if lines else "]")
            tail = f"[^\\W\\d_]++(?=[{stops}])|" if stops else ""
            self.units = f"{SPACE}*(?:{tail}{rest}+)|{SPACE}+" + ("|\n" if lines else "")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        size = os.path.getsize(path)
        if size > MAX_MODEL_BYTES:
            raise ValueError(f"{path} holds {size} bytes; vocabularies up to {MAX_MODEL_BYTES} are shipped to executors.")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = ((model.is_byte, "byte"), (model.is_unknown, "unknown"), (model.is_control, "other"), (model.is_unused, "other"))
        pieces = [
            (model.id_to_piece(i), model.get_score(i), next((k for test, k in kinds if test(i)), "normal"))
            for i in range(model.get_piece_size())
        ]
        return cls(pieces, prefix=model.encode("a", out_type=str)[0].startswith(SPACE))

    def fallback(self, character: str) -> tuple[int, ...]:
        if self.byte_ids:
            return tuple(self.byte_ids[b] for b in character.encode())
        return (self.unknown_id,)


def stream(text: Iterable[str], words: Vocabulary) -> Iterator[tuple[int, ...]]:
    """Ids of the best segmentation of a stream of characters, in committed runs.

    Of equal scores the path with the longer last piece wins. What is held is
    the positions since the last commit, at least the longest piece.
    """
    pending: list[str] = []  # characters since the last commit
    best: list[float] = [0.0]  # by boundary since the last commit
    back: list[int] = [0]
    step: list[int | tuple[int, ...]] = [()]
    longest, backward, known, due = words.longest, words.backward, words.ids, 2 * words.longest
    end = 0
    for character in text:
        pending.append(character)
        top, source, taken = None, end, ()
        level = backward
        for at in range(end, -1, -1):
            found = level.get(pending[at])
            if found is None:
                break
            level, piece, gain = found
            if piece >= 0:
                score = best[at] + gain
                if top is None or score >= top:
                    top, source, taken = score, at, piece
        if top is None or character not in known:
            score = best[end] + words.unknown_score
            if top is None or score > top:
                top, source, taken = score, end, words.fallback(character)
        end += 1
        best.append(top)
        back.append(source)
        step.append(taken)
        if end >= due:
            # Boundaries a later piece can start from; follow their paths back until they meet.
            live = set(range(end - longest + 1, end + 1))
            while len(live) > 1:
                last = max(live)
                live.remove(last)
                live.add(back[last])
            met = live.pop()
            if met:
                yield _path(met, back, step)
                del pending[:met]
                base = best[met]
                best = [b - base for b in best[met:]]
                back = [max(0, b - met) for b in back[met:]]
                step = step[met:]
                end -= met
            due = end + longest
    yield _path(end, back, step)


def _path(end: int, back: list[int], step: list[int | tuple[int, ...]]) -> tuple[int, ...]:
    """The ids up to a boundary; a step is a piece's id or the ids of a character without one."""
    ids: list[int] = []
    while end:
        taken = step[end]
        if taken.__class__ is int:
            ids.append(taken)
        else:
            ids.extend(reversed(taken))
        end = back[end]
    ids.reverse()
    return tuple(ids)


class Codec(dict):
    """Encodes and decodes; remembers the ids of short units (the text between sure boundaries).

    When full it forgets what was not asked for since it was last full.
    """

    def __init__(self, words: Vocabulary) -> None:
        super().__init__()
        self.words = words
        self.split = re.compile(words.units).findall
        self.mark = words.fallback(SPACE)
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, unit: str) -> tuple[int, ...]:
        found = self.older.get(unit)
        if found is None:
            found = tuple(chain.from_iterable(stream(unit, self.words)))
        if len(unit) <= _CACHED_LENGTH:
            if len(self) >= _CACHED_UNITS:
                self.older = dict(self)
                self.clear()
            self[unit] = found
        return found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for i, part in enumerate(text.split(SPACE)):
            # The mark itself, met in a text, goes by bytes: else it would come back as a space.
            if i:
                out.extend(self.mark)
            spaced = part.replace(" ", SPACE)
            if not i and self.words.prefix:
                spaced = SPACE + spaced
            out.extend(chain.from_iterable(map(self.__getitem__, self.split(spaced))))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        try:
            text = b"".join(map(self.words.shown.__getitem__, ids)).decode("utf-8", "replace")
        except KeyError as error:
            raise ValueError("An id is outside the vocabulary.") from error
        return text[1:] if self.words.prefix and text.startswith(" ") else text


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 (of the ids decoded again) and round_trip of every document.

    `model_path` is read on the driver. Every text comes back unchanged from its
    ids if the vocabulary has byte pieces; `round_trip` says so for each row.
    Texts are taken as they are: no normalisation but the mark for spaces and,
    where the model asks for it, one in front. Null and empty texts give no ids.
    Ids of documents may be null or repeat: one row out per row in. Other
    columns of the input are neither read nor returned.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    held: list[Codec] = []

    def encoded(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        if not held:
            held.append(Codec(shipped.value))
        codec = held[0]
        runs, digests, same = [], [], []
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            run = codec.encode(text)
            again = codec.decode(run)
            runs.append(np.array(run, np.int32))
            digests.append(hashlib.sha256(again.encode()).hexdigest())
            same.append(again == text)
        ends = np.cumsum([0, *map(len, runs)], dtype=np.int32)
        values = np.concatenate(runs) if runs else np.empty(0, np.int32)
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(np.diff(ends), pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                pa.array(digests, pa.string()),
                pa.array(same, pa.bool_()),
            ],
            ["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids array<int>, decoded_sha256 string, round_trip boolean"
    return map_texts(docs, encoded, schema, id_col, text_col)


def decode_ids(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of each list of ids; a null list gives the empty text, an unknown id an error."""
    shipped = tokens.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shipped.value)
        for batch in batches:
            texts = [codec.decode(run or ()) for run in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(decoded, f"doc_id {kind}, text string")
