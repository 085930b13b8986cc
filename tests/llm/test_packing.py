import functools
import random
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tablewash.llm import packing
from tablewash.llm.packing import TIERS, Ids, _Document, _Piece, pack_block, pack_documents, powers_of_two

PATH = "/opt/tokenizers/byte_bpe_50k.json"
NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_id"]
ODD = [
    "", " ", "\n", "  a  b ", "a\n b", "a \nb", "x  y", "x  y", "tab\t end", " lead", "trail ", "don't  stop, won't",
    "a <|endoftext|> b", "a<|endoftext|>b c", "<|endoftext|>", "é ü\x85 z", "\x1c a \x1d b", "日本 語 テキスト", "1 2  3\r\n 4", "🙂 🙂🙂 x",
]


@functools.cache
def _tokenizer():
    return Tokenizer.from_file(PATH)


@functools.cache
def _whole(text):
    return _tokenizer().encode(text, add_special_tokens=False).ids


def _read(parts):
    return np.frombuffer(b"".join(parts), "<u4").tolist()


@pytest.mark.parametrize("span", [1, 3, 1 << 20])
def test_ids_are_those_of_the_whole_text(monkeypatch, span):
    monkeypatch.setattr(packing, "_SPAN", span)
    monkeypatch.setattr(packing, "_REMEMBERED", 5)
    ids, pick = Ids(PATH), random.Random(3)
    marks = [" ", "  ", "\n", "\t", " ", " a", "b ", "don't", ",", "12", "é", "<|endoftext|>", " the", " "]
    texts = ODD + ["".join(pick.choices(marks, k=pick.randint(1, 40))) for _ in range(300)]
    for text in texts:
        assert _read(ids.of(text)) == _whole(text), repr(text)


def test_the_fast_encoder_means_the_same():
    fast = packing.fast_encoding(PATH)
    for code in [*range(0x180), *range(0x2010, 0x205F), 0x20AC]:
        for text in (f"a{chr(code)}b", f" {chr(code)}{chr(code)} x", f"x {chr(code)}", f"{chr(code)} \n{chr(code)}'s I'll"):
            if not packing._ODD.search(text):
                assert fast.encode_ordinary(text) == _whole(text), repr(text)
    assert packing.fast_encoding("/opt/tokenizers/word_bpe_49k.json") is None
    long = "ab" * 3000 + " " + "!" * 2000 + " " * 1500 + "x"
    assert _read(Ids(PATH).of(long)) == _whole(long)


def test_ids_of_real_texts(spark):
    ids = Ids(PATH)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert _read(ids.of(r[0] or "")) == _whole(r[0] or "")


def _check(rows, docs):
    """Every id once, sequences exactly full, steps of one size."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for key, text in docs.items():
        at, ids = 0, []
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
            ids += np.frombuffer(r["ids"], "<u4").tolist()
            assert len(r["ids"]) == 4 * r["length"] and r["doc_tokens"] == len(_whole(text or "")) + 1
        assert ids == [*_whole(text or ""), 1]
    steps = defaultdict(list)
    for sequence, own in by_sequence.items():
        own.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in own)
        assert [r["offset"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own[:-1]]))
        assert {r["tier"] for r in own} == {total} and total <= 2048 and total & (total - 1) == 0
        assert len({r["step_id"] for r in own}) == 1
        steps[own[0]["step_id"]].append((total, sum(r["length"] ** 2 for r in own)))
    return by_sequence, steps


def _texts(pick, n):
    words = ["alpha", "be", "Gamma's", "δ", "e,", "f.\n", "12", "zzzzzz"]
    return {i: " ".join(pick.choices(words, k=int(pick.paretovariate(0.7) * 20) % 6000)) for i in range(n)}


def test_pieces_of_random_documents(spark):
    docs = _texts(random.Random(5), 400) | {1000: None, 1001: "", 1002: "long " * 30000}
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs.items()], "doc_id long, text string, start int, `a.b` string").repartition(3)
    made = pack_documents(frame, PATH, block_tokens=20_000, step_tokens=8192)
    assert made.columns == NAMES
    rows = made.collect()
    by_sequence, steps = _check(rows, docs)
    # Few small sequences at the ends of tasks, most documents whole, steps of about equal work.
    small = [s for s in by_sequence.values() if s[0]["tier"] < TIERS[0]]
    assert len(small) <= 3 * 8
    short = [i for i, t in docs.items() if len(_whole(t or "")) < 2048]
    cut = sum(len([r for r in rows if r["doc_id"] == i]) > 1 for i in short)
    assert cut < 0.5 * len(short)
    part = [(step >> 33, s[0][0]) for step, s in steps.items() if sum(size for size, _ in s) != 8192]
    assert len(part) == len(set(part))  # one of a size and task at most is not full
    assert all(len({size for size, _ in s}) == 1 for s in steps.values())


def test_odd_tables(spark):
    schema = "doc_id string, text string"
    assert pack_documents(spark.createDataFrame([], schema), PATH).collect() == []
    rows = pack_documents(spark.createDataFrame([(None, None), ("a", "x y"), ("a", "x y")], schema).coalesce(1), PATH).collect()
    assert sorted((r["doc_id"] or "", r["start"], r["length"]) for r in rows if r["doc_id"] is None) == [("", 0, 1)]
    assert sum(r["length"] for r in rows) == 1 + 2 * (len(_whole("x y")) + 1)
    with pytest.raises(ValueError):
        pack_documents(spark.createDataFrame([], schema), PATH, tiers=(100, 2048))


def _piece(length, place):
    return _Piece(length, place, _Document(place, length), 0, b"abcd" * length)


@pytest.mark.parametrize("seed", range(5))
def test_blocks_are_full_but_for_one_window(seed):
    pick = random.Random(seed)
    pieces = [_piece(pick.choice([1, 5, 256, 257, 512, 700, 1024, 1025, 2047, pick.randint(1, 2047)]), i) for i in range(pick.randint(0, 300))]
    total = sum(p.length for p in pieces)
    full, rest = pack_block(list(pieces), TIERS)
    ends = list(powers_of_two(rest, TIERS[-1]))
    for size, window in [*full, *ends]:
        assert sum(p.length for p in window) == size
    assert sum(size for size, _ in [*full, *ends]) == total
    assert sum(p.length for p in rest) < 2048
    sizes = [size for size, _ in ends]
    assert sizes == sorted(set(sizes), reverse=True)
    whole = {id(p) for p in pieces}
    # A document that fits a tier lies in a window of that tier or fills a longer one.
    assert all(any(id(p) in whole or p.length < size for p in w) for size, w in full)


def test_short_documents_fill_the_gaps_of_long_windows():
    pieces = [_piece(1900, 0), _piece(148, 1), _piece(600, 2), _piece(424, 3)]
    full, rest = pack_block(pieces, TIERS)
    assert [(s, [p.length for p in w]) for s, w in full] == [(2048, [1900, 148]), (1024, [600, 424])] and not rest
