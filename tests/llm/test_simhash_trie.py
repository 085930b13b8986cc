import random

import numpy as np
import xxhash

from tablewash.llm.simhash_trie import close_pairs, fingerprint, keep_one_of_each_group, near_duplicates


def _plain(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _groups(prints):
    """{place: component} by comparing all fingerprints."""
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                x, y = sorted((root(i), root(j)))
                group[y] = x
    return [root(i) for i in range(len(prints))]


def _texts(pick):
    words = ["Alpha", "beta", "ÉTÉ", "gamma", "delta,", "x", "to", "of"]
    base = [" ".join(pick.choices(words, k=pick.randint(30, 160))) for _ in range(25)]
    out = []
    for t in base:
        out.append(t)
        for _ in range(pick.randint(0, 6)):
            own = t.split(" ")
            own[pick.randrange(len(own))] = pick.choice(words)
            out.append(pick.choice([" ", "\n", "\t "]).join(own))
    return [*out, *out[:20], None, "", " \n", "one", "One two", "one two three FOUR", "nb sp a b c d e"]


def test_fingerprint():
    for text in _texts(random.Random(1)):
        assert fingerprint((text or "").encode()) == _plain(text)
    assert fingerprint(b"a b c d e f g " * 60_000) == _plain("a b c d e f g " * 60_000)


def test_pairs_against_all_pairs(spark):
    pick = random.Random(5)
    prints = set()
    for _ in range(60):
        start = pick.getrandbits(64)
        prints.add(start)
        for _ in range(12):
            other = start
            for b in pick.sample(range(64), pick.randint(1, 6)):
                other ^= 1 << b
            prints.add(other)
    prints |= set(range(40))  # a dense corner of the trie
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for errors in (1, 3, 4):
        found = [(r["a"], r["b"]) for r in close_pairs(frame, errors).collect()]
        wanted = {
            (a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= errors
        }
        assert len(found) == len(set(found)) and set(found) == wanted


def test_components_of_documents(spark):
    texts = _texts(random.Random(2))
    rows = [(3 * i + 1, t, "x", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id int").repartition(4)
    out = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    prints = [_plain(t) for t in texts]
    groups = _groups(prints)
    assert len(out) == len(rows)
    for i, (p, g) in enumerate(zip(prints, groups, strict=True)):
        assert (out[3 * i + 1]["fingerprint"], out[3 * i + 1]["component_id"]) == (f"{p:016x}", 3 * g + 1)
    kept = keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({3 * g + 1 for g in groups})


def test_edges(spark):
    schema = "doc_id bigint, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (None, "else where"), (None, "else where"), (9, None)], schema)
    out = near_duplicates(docs).collect()
    assert sorted((r["component_id"] is None, r["component_id"] or 0) for r in out) == [
        (False, 7), (False, 7), (False, 7), (False, 9), (True, 0), (True, 0)
    ]
    assert sorted(str(r["doc_id"]) for r in keep_one_of_each_group(docs).collect()) == ["7", "9", "None"]
