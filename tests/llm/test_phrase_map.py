"""The counts behind the map of frequent words and pairs travel as short hashes, and none is lost."""

import numpy as np
import pyarrow as pa

from tablewash.llm import collocations as c


def test_short_hashes_keep_all_counts():
    texts = ["a b a b, c", "a b", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array([t.encode() for t in texts], pa.binary())], ["lang", "text"])
    found = {}
    for part in c._hashed_counts(iter([batch]), c._HASH_VALUES):
        found |= dict(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
    assert sorted(found.values()) == [1, 1, 3, 3, 3]  # words a 3, b 3, c 1; pairs ab 3, ba 1
    assert all(0 <= h < 1 << 32 for h in found)


def test_every_frequent_word_is_marked(spark):
    texts = [("en", " ".join(f"w{i}" for i in range(200)))] * 5
    df = spark.createDataFrame(texts, "lang string, text string").selectExpr("lang", "cast(text as binary) as text")
    block = c._Block([t.encode() for _, t in texts], ["en"] * 5)
    h = block.hashes(0)
    marks = c.frequent_map(df, 5)
    assert c._marked(marks, h).all() and c._marked(marks, c._pairs(h)[block.near]).all()
    assert not c._marked(c.frequent_map(df, 6), h).any() and np.count_nonzero(marks)


def test_counts_travel_packed_and_whole():
    pick = np.random.default_rng(1)
    values = 1 << 32
    held, total = [], {}
    for _ in range(3):
        h = np.unique(np.concatenate([pick.integers(0, values, 300_000), [0, 5, values - 1]]))
        times = np.where(pick.random(h.size) < 0.1, pick.integers(2, 70_000, h.size), 1)
        times[h == 5] = 40_000_000_000
        held.append(pa.RecordBatch.from_arrays([pa.array(h), pa.array(times)], ["h", "c"]))
        for x, n in zip(h.tolist(), times.tolist(), strict=True):
            total[x] = total.get(x, 0) + n
    rows = pa.Table.from_batches(c._packed(iter(held), values))
    assert rows.nbytes < 5 * sum(b.num_rows for b in held)  # 16 as pairs of longs
    order = rows.sort_by("at").to_batches(max_chunksize=100)
    for least in (1, 3, 50_000):
        found = [h for b in c._unpacked(iter(order), least) for h in b.column(0).to_pylist()]
        assert sorted(found) == sorted(x for x, n in total.items() if n >= least)


def test_rare_phrases_of_frequent_pairs_are_left_out(spark):
    pick = np.random.default_rng(2)
    texts = [("en", " ".join(pick.choice(["a", "b", "c", "d", "e", "f", "g", "h"], 400))) for _ in range(5)] + [("en", "x y z u v")] * 60
    df = spark.createDataFrame(texts, "lang string, text string").selectExpr("lang", "cast(text as binary) as text")
    marks = c.frequent_map(df, 20)
    edges = c.weighted_edges(df, marks, c.longer_map(df, marks, 20, 5), 5).where("words = 5").collect()
    assert [(r["phrase"], r["c"]) for r in edges] == [("x y z u v", 60)]  # 1,928 edges with a full second map
