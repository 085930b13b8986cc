import hashlib
import os
import random
from itertools import chain

import pytest
import sentencepiece

from tablewash.llm.queries import PIECES
from tablewash.llm.viterbi_pieces import SPACE, Codec, Vocabulary, decode_ids, encode_texts, stream

pytestmark = pytest.mark.skipif(not os.path.exists(PIECES), reason="the tokenizer's file is absent")


@pytest.fixture(scope="module")
def words():
    return Vocabulary.load(PIECES)


def _small(pieces, prefix=True):
    base = [("<unk>", 0.0, "unknown")] + [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    return Vocabulary(base + [(p, s, "normal") for p, s in pieces], prefix)


def _best(text, vocabulary):
    """Greatest score by the whole table of boundaries."""
    best = [0.0]
    for end in range(1, len(text) + 1):
        ways = [best[a] + vocabulary.ids[text[a:end]][1] for a in range(end) if text[a:end] in vocabulary.ids]
        if text[end - 1] not in vocabulary.ids:
            ways.append(best[end - 1] + vocabulary.unknown_score)
        best.append(max(ways))
    return best[-1]


def _score(ids, vocabulary):
    scores = {i: s for i, s in vocabulary.ids.values()}
    total, at = 0.0, 0
    while at < len(ids):
        if ids[at] in scores:
            total += scores[ids[at]]
            at += 1
        else:
            first = vocabulary.shown[ids[at]][0]
            at += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            total += vocabulary.unknown_score
    return total


def test_streaming_gives_the_best_score():
    pick = random.Random(4)
    for _ in range(60):
        pieces = {"".join(pick.choices("abc", k=pick.randint(1, 5))) for _ in range(12)} | {"a", "b"}
        vocabulary = _small([(p, pick.choice([-1.0, -2.5, -7.0, -0.5])) for p in sorted(pieces)])
        text = "".join(pick.choices("abcdé", k=pick.randint(0, 300)))
        runs = list(stream(text, vocabulary))
        ids = list(chain.from_iterable(runs))
        assert _score(ids, vocabulary) == pytest.approx(_best(text, vocabulary))
        assert b"".join(vocabulary.shown[i] for i in ids).decode() == text
        assert len(text) < 60 or len(runs) > 1


def test_units_change_nothing(words):
    pick = random.Random(5)
    letters = "the of and  \n.,!?#x1é▁日本\t'-_²"
    codec = Codec(words)
    for _ in range(200):
        text = "".join(pick.choices(letters, k=pick.randint(1, 60))).replace(SPACE, "")
        if text:
            whole = list(chain.from_iterable(stream(SPACE + text.replace(" ", SPACE), words)))
            assert _score(codec.encode(text), words) == pytest.approx(_score(whole, words))


def test_round_trip_and_library(words):
    codec = Codec(words)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["", " ", "a", " a  b ", "line\nline\n\n", "▁mark▁", "naïve café — 日本語 😀", "\x00\x01", "x" * 5000, "tab\tand\r\n", "the " * 2000]
    for text in texts:
        ids = codec.encode(text)
        assert codec.decode(ids) == text
        if SPACE not in text:
            assert model.decode(ids) == text
    assert codec.encode("") == []
    with pytest.raises(ValueError, match="outside"):
        codec.decode([10**6])
    assert _small([("a", -1.0)], prefix=False).units


def test_tables(spark):
    texts = ["The quick brown fox.", "", None, " padded ", "É" * 3000]
    docs = spark.createDataFrame([(i, t, [9]) for i, t in enumerate(texts)] + [(None, "x", [1]), (0, texts[0], [2])], "doc_id bigint, text string, ids array<int>").repartition(3)
    out = encode_texts(docs, PIECES)
    rows = out.collect()
    assert len(rows) == 7 and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    for r in rows:
        if r["doc_id"] is not None:
            assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in decode_ids(out, PIECES).collect()}
    assert back == {**{i: t or "" for i, t in enumerate(texts)}, None: "x"}
    assert encode_texts(docs.limit(0), PIECES).collect() == []
