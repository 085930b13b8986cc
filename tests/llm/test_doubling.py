import hashlib
import random

import numpy as np

from tablewash.llm.doubling import levels, remove_repeated_windows, window_hashes


def _cut(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def _expected(docs, length=13):
    first = {}
    for i, t in docs:
        w = _cut(t)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, t in docs:
        w = _cut(t)
        gone = {p for k in range(len(w) - length + 1) if first[tuple(w[k : k + length])] < i for p in range(k, k + length)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def _docs(pick):
    words = "a bb The the ÉÉ of, and x1 . - go".split()
    passages = [" ".join(pick.choices(words, k=pick.randint(10, 60))) for _ in range(8)]
    docs = []
    for i in range(120):
        own = pick.choices(words, k=pick.randint(0, 80))
        for _ in range(pick.randint(0, 2)):
            p = pick.choice(passages).split(" ")
            if pick.random() < 0.4:
                p[pick.randrange(len(p))] = "edit"
            at = pick.randrange(len(own) + 1)
            own[at:at] = p
        docs.append((i * 3, pick.choice([" ", "\n", " \t"]).join(own)))
    return docs + [(1000 + k, docs[k][1]) for k in range(30)] + [(2000, None), (2001, ""), (2002, "lone"), (2003, "aa " * 500), (2004, "aa " * 30)]


def test_levels_and_hashes():
    assert levels(13, 7) == [7, 13] and levels(50, 4) == [4, 7, 13, 25, 50] and levels(1, 1) == [1]
    words = np.array([random.Random(1).choice([3, 5, 9]) for _ in range(300)], np.uint64)
    for n in (1, 2, 3, 7, 13):
        by = {}
        for k, h in enumerate(window_hashes(words, n).tolist()):
            assert by.setdefault(h, tuple(words[k : k + n])) == tuple(words[k : k + n])
        assert len(by) == len(set(by.values()))


def test_against_brute_force(spark):
    docs = _docs(random.Random(8))
    frame = spark.createDataFrame([(i, t, "x", 5) for i, t in docs], "doc_id bigint, text string, doc string, h int").repartition(5)
    for lowest in (7, 3):
        out = remove_repeated_windows(frame, lowest=lowest).collect()
        assert sorted(tuple(r) for r in out) == _expected(docs)


def test_edges(spark):
    schema = "doc_id bigint, text string"
    assert remove_repeated_windows(spark.createDataFrame([], schema)).collect() == []
    text = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (4, text + " more"), (5, text), (None, None)], schema)
    out = remove_repeated_windows(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in out) == [
        ("4", 20, 0), ("4", 20, 0), ("4", 21, 0), ("5", 20, 20), ("None", 0, 0), ("None", 20, 0)
    ]


def test_levels_between_are_gone_through(spark):
    pick = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    long, short = pick.choices(words, k=70), pick.choices(words, k=30)
    docs = []
    for i in range(40):
        own = pick.choices(words, k=pick.randint(0, 60))
        own += [[], long, long[:55], long[10:], short, long[:30] + ["edit"] + long[31:]][i % 6]
        docs.append((i, " ".join(own)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    out = remove_repeated_windows(frame, length=50, lowest=4).collect()
    assert sorted(tuple(r) for r in out) == _expected(docs, 50)
    assert any(r["n_removed"] for r in out)
    # The short passages repeat at 25 words, and nothing is left at 50.
    few = [(i, t) for i, t in docs if i % 6 in (0, 4)]
    out = remove_repeated_windows(spark.createDataFrame(few, frame.schema), length=50, lowest=4).collect()
    assert sorted(tuple(r) for r in out) == _expected(few, 50)
    assert not any(r["n_removed"] for r in out)
    # Nothing repeats at the lowest level either.
    lone = [(i, " ".join(f"d{i}x{k}" for k in range(60))) for i in range(3)]
    out = remove_repeated_windows(spark.createDataFrame(lone, frame.schema), length=50, lowest=4).collect()
    assert sorted(tuple(r) for r in out) == _expected(lone, 50)
