"""Short texts are hashed together: as few calls as blocks, and what is found is what each text alone gives."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tablewash.llm import suffix_dedup as s

LENGTH = 120


def _some(seed, n):
    pick = random.Random(seed)
    return ["".join(pick.choices("ab c", k=pick.randint(LENGTH, 3 * LENGTH))).encode() for _ in range(n)]


def _anchor_batch(texts):
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, pa.array(texts, pa.binary())], ["t1", "t2", "bytes"])


def test_anchors_of_many_texts_take_few_calls(monkeypatch):
    calls = []
    mixed = s._mixed
    monkeypatch.setattr(s, "_mixed", lambda *a: calls.append(1) or mixed(*a))
    rows = sum(b.num_rows for b in s._anchor_rows(LENGTH)(iter([_anchor_batch(_some(1, 200))])))
    assert rows > 200 and len(calls) < 20


@pytest.mark.parametrize("part", [1, 500, 1 << 17])
@pytest.mark.parametrize("block", [64, 1 << 20])
def test_anchors_by_brute_force(monkeypatch, part, block):
    monkeypatch.setattr(s, "_PART", part)
    monkeypatch.setattr(s, "_BLOCK", block)
    texts = [b"", b"short", *_some(2, 20), b"a" * LENGTH, b""]
    expected = set()
    for row, text in enumerate(texts):
        h = s.Prefixes(text).of(s._ANCHOR)
        for start in range(len(text) - LENGTH + 1):
            own = h[start : start + LENGTH - s._ANCHOR + 1]
            expected |= {(row, start + int(k), int(own[k])) for k in np.flatnonzero(own == own.min())}
    found = s.anchors(texts, LENGTH)
    assert sorted(zip(*(x.tolist() for x in found), strict=True)) == sorted(expected)


def test_hashes_at_places():
    text = _some(3, 1)[0] * 4
    for length in (8, 40, 65, 120, 300):
        whole = s.Prefixes(text, 1).of(length)
        for places in (np.arange(whole.size), np.array([0, 7, whole.size - 1]), np.empty(0, np.int64)):
            assert s.Prefixes(text, 1).at(length, places).tolist() == whole[places].tolist()


def test_phrases_of_joined_segments(monkeypatch):
    texts = _some(4, 30)
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array(texts, pa.binary())], ["sid", "bytes"])
    for rows in (s._phrase_rows(LENGTH), s._bare_rows(LENGTH)):
        found = []
        for part in (1, 1 << 17):
            monkeypatch.setattr(s, "_PART", part)
            found.append(sorted(map(str, pa.Table.from_batches(rows(iter([batch]))).to_pylist())))
        assert found[0] == found[1] and found[0]


def test_an_anchor_is_one_row_a_text(monkeypatch):
    """A line that a text repeats many times must not make as many rows of one key; whether it stands at two places is kept."""
    monkeypatch.setattr(s, "_BLOCK", 500)
    line = "".join(random.Random(5).choices("abc ", k=90)).encode()
    texts = [line * 200, b"x" * 150 + line * 200, b"", *_some(6, 5)]
    rows = [tuple(r.values()) for b in s._anchor_rows(LENGTH)(iter([_anchor_batch(texts)])) for r in b.to_pylist()]
    row, place, h = s.anchors(texts, LENGTH)
    expected = {}
    for r, p, x in zip(row.tolist(), place.tolist(), h.view(np.int64).tolist(), strict=True):
        expected.setdefault((x, r), set()).add(p)
    found = {(x, t): low != high for x, low, high, t, _ in rows}
    assert len(rows) == len(found) < row.size / 10
    assert found == {k: len(p) > 1 for k, p in expected.items()}
