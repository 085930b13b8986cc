import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tablewash.llm.suffix_dedup import Prefixes, drop_repeated_bytes, remove_repeated_bytes, whole_characters

LENGTH = 120


def _expected(texts, length):
    count = {}
    for t in texts:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            count[s] = count.get(s, 0) + 1
    out = []
    for t in texts:
        raw = (t or "").encode()
        keep = [True] * len(raw)
        for k in range(len(raw) - length + 1):
            if count[raw[k : k + length]] > 1:
                keep[k : k + length] = [False] * length
        rest = bytes(b for b, k in zip(raw, keep) if k)
        spans = sum(1 for i, k in enumerate(keep) if not k and (not i or keep[i - 1]))
        out.append((len(raw), len(raw) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


def _texts(pick, length):
    letters = "abcdefgh  éü\n,xyz"

    def noise(n):
        return "".join(pick.choices(letters, k=n))

    base = [noise(pick.randint(length // 2, 6 * length)) for _ in range(12)]
    out = list(base)
    for t in base:
        for _ in range(pick.randint(0, 4)):
            own = list(t)
            for _ in range(pick.randint(0, 4)):
                own[pick.randrange(len(own))] = pick.choice(["Q", "", "zz", "é"])
            out.append(noise(pick.randint(0, 80)) + "".join(own) + noise(pick.randint(0, 80)))
    edge = noise(length + 3)
    for cut in (length - 1, length, length + 1, length + 2):
        out.append(noise(40) + edge[:cut] + noise(40))
        out.append(noise(30) + edge[-cut:] + noise(50))
    common = noise(length - 5)
    out += [noise(60) + common + noise(60) for _ in range(15)]
    out += ["Le " * 200, "Le " * 41 + "end", "x" + "Le " * 40 + noise(50), "ab" * (length // 2), "ab" * (length // 2) + "a", "a" * 1000, noise(30) + "twelve chars" * 40 + noise(70)]
    twice = noise(length + 40)
    out += [noise(20) + twice + noise(33) + twice + noise(9), *base[:3], base[0], None, "", "short", "short", noise(length), noise(length - 1)]
    return out


def test_hashes_tell_substrings_apart():
    raw = bytes(random.Random(2).choices(b"ab", k=3000))
    for length in (8, 40, 65, 127, 400):
        for salt in (0, 1):
            by = {}
            for k, h in enumerate(Prefixes(raw, salt).of(length).tolist()):
                assert by.setdefault(h, raw[k : k + length]) == raw[k : k + length]


def test_against_brute_force(spark):
    for seed, length in ((1, LENGTH), (2, 400)):
        texts = _texts(random.Random(seed), length)
        rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, seq string, sid int").repartition(6)
        out = {r["doc_id"]: r for r in remove_repeated_bytes(docs, length).collect()}
        assert len(out) == len(texts)
        found = [(out[i]["n_bytes"], out[i]["n_removed"], out[i]["n_spans"], out[i]["kept_sha256"]) for i in range(len(texts))]
        wrong = [i for i, (a, b) in enumerate(zip(found, _expected(texts, length), strict=True)) if a != b]
        assert not wrong, [(i, found[i], _expected(texts, length)[i]) for i in wrong[:5]]


def test_edges(spark):
    schema = "doc_id bigint, text string, n_chars bigint"
    assert remove_repeated_bytes(spark.createDataFrame([], schema)).collect() == []
    text = "".join(random.Random(9).choices("abcdefghé ", k=500))
    docs = spark.createDataFrame([(None, text, 1), (3, text, 1), (3, text, 1), (4, text[:100] + "other" * 10, 1), (5, None, 7)], schema)
    out = remove_repeated_bytes(docs).collect()
    size = len(text.encode())
    assert sorted((str(r["doc_id"]), r["n_removed"], r["n_spans"]) for r in out) == [("3", size, 1), ("3", size, 1), ("4", 0, 0), ("5", 0, 0), ("None", size, 1)]
    kept = drop_repeated_bytes(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] is None, r["n_chars"]) for r in kept.collect()) == [("3", False, 0), ("3", False, 0), ("4", False, 150), ("5", True, 7), ("None", False, 0)]


def test_characters_stay_whole():
    raw = "aéb".encode()
    for bits in range(16):
        keep = np.array([bits >> i & 1 for i in range(4)], bool)
        whole_characters(raw, keep).decode()
    assert whole_characters(raw, np.array([True, True, False, False])).decode() == "aé"
