import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablewash.llm import collocations as c
from tablewash.llm.collocations import collocations

SCHEMA = "doc_id long, text string, lang string, phrase int, `a.b` string"


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _pieces(docs):
    for _, text, lang in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", _lower(text)):
            yield "und" if lang is None else lang, re.findall("[^ \t]+", piece)


def _counts(docs, longest):
    f, n = defaultdict(Counter), Counter()
    for lang, w in _pieces(docs):
        n[lang] += len(w)
        for k in range(1, longest + 1):
            f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def _expected(docs, least, longest=5, top=2000):
    f, n = _counts(docs, longest)
    rows = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least}
        inside = {
            p[i : i + k] for p, a in frequent.items() for k in range(1, len(p)) for i in range(len(p) - k + 1) if counts[p[i : i + k]] == a
        }
        own = []
        for p, a in frequent.items():
            if len(p) > 1 and p not in inside:
                cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                own.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        own.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        rows += [(lang, i, *r) for i, r in enumerate(own[:top], 1)]
    return sorted(rows)


def _docs(pick, n=120):
    words = ["The", "of", "é", "naïve", "x1", "of\t", "a ", "go", "日本", "#", "zz", "\x00", "Ünder"]
    lines = [" ".join(pick.choices(words, k=pick.randint(1, 14))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [pick.choice(lines) if pick.random() < 0.5 else " ".join(pick.choices(words, k=pick.randint(0, 9))) for _ in range(pick.randint(0, 8))]
        docs.append((i, pick.choice([".", "\n", " ", "! ", "\r\n", ",,"]).join(parts), pick.choice(["en", "en", "de", None, "und", ""])))
    return docs


@pytest.mark.parametrize("seed", range(4))
def test_against_all_phrases_counted_plainly(spark, seed, monkeypatch):
    monkeypatch.setattr(c, "_BLOCK", 300)
    pick = random.Random(seed)
    docs = _docs(pick) + [(1000, None, "en"), (1001, "", None), (None, "of go " * 3000, "en"), (1002, "a", "de"), (1002, "a", "de")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA).repartition(3)
    longest, top = [(5, 2000), (3, None), (2, 3), (4, 2000)][seed]
    # A tiny map has many wrong bits, which must not change the result.
    rows = collocations(frame, min_count=6, longest=longest, top=top, map_bits=[1 << 26, 64, 256, 1024][seed]).collect()
    assert sorted(tuple(r)[:8] for r in rows) == _expected(docs, 6, longest, top or 10**9)
    assert rows


def test_paths_are_runs_without_a_branch(spark):
    long = " ".join(f"w{i}" for i in range(40))
    texts = [long] * 7 + [long + " then more words follow here"] * 3 + ["a b c d e"] * 5 + ["b c d e f"] * 5
    frame = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in enumerate(texts)], SCHEMA)
    rows = {r["phrase"]: (r["path"], r["place"]) for r in collocations(frame, min_count=3, top=None).collect()}
    words = [*long.split(), *"then more words follow here".split()]
    for i in range(36):
        assert rows[" ".join(words[i : i + 5])] == ("w0 w1 w2 w3 w4", i)
    # The node before "then" passes only part of what it gets.
    for i in range(36, 41):
        assert rows[" ".join(words[i : i + 5])] == ("w36 w37 w38 w39 then", i - 36)
    assert rows["b c d e f"] == ("b c d e f", 0)


def test_no_rows(spark):
    for docs in ([], [(1, None, None, 1, "x")], [(1, "one two three", "en", 1, "x")]):
        assert collocations(spark.createDataFrame(docs, SCHEMA), min_count=2).collect() == []


def test_products_beyond_64_bits(spark):
    rows = [("en", "a b", 2, 4 * 10**12), ("en", "a", 1, 5 * 10**12), ("en", "b", 1, 4 * 10**12 + 1), ("en", "", 0, 9 * 10**15)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, words int, f long")
    import tablewash.llm.collocations as module

    saved = module.phrase_counts, module.frequent_map
    module.phrase_counts, module.frequent_map = (lambda *x: counts), (lambda *x: np.zeros(1, np.uint64))
    try:
        found = collocations(spark.createDataFrame([], SCHEMA)).collect()
    finally:
        module.phrase_counts, module.frequent_map = saved
    assert [r["score"] for r in found] == [1000 * 4 * 10**12 * 9 * 10**15 // (5 * 10**12 * (4 * 10**12 + 1))]


def test_word_hashes_depend_on_the_word_alone():
    texts = [b"Ab cd\tab", b"", b"ab.cd ab", b"x" * 5000 + b" ab"]
    block = c._Block(texts, ["en"] * 4)
    words = [block.text(i, 1) for i in range(block.start.size)]
    assert words == [b"ab", b"cd", b"ab", b"ab", b"cd", b"ab", b"x" * 5000, b"ab"]
    for seed in (0, 1):
        h = block.hashes(seed)
        assert all((x == y) == (a == b) for (x, a), (y, b) in itertools.product(zip(h, words), repeat=2))
    assert c._Block(texts[:1], ["de"]).hashes(0)[0] != block.hashes(0)[0]
    assert block.near.tolist() == [True, True, False, False, True, False, True]
