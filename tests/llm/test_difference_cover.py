import random

from tablewash.llm.difference_cover import suffix_order


def test_against_sorted_suffixes(spark):
    pick = random.Random(6)
    for letters, depth in ((2, 10**6), (3, 10**6), (4, 12)):
        seqs = {s: [pick.randrange(letters) for _ in range(pick.randint(0, 40))] for s in range(12)}
        seqs[50] = [1] * 60
        seqs[51] = list(seqs[0])
        rows = [(s, p, x, 2) for s, own in seqs.items() for p, x in enumerate(own)]
        frame = spark.createDataFrame(rows, "seq long, pos long, sym long, size long").repartition(5)
        out = suffix_order(frame, depth).collect()
        assert sorted((r["seq"], r["pos"]) for r in out) == sorted((s, p) for s, p, _, _ in rows)
        assert sorted(r["rank"] for r in out) == list(range(len(rows)))
        order = [seqs[r["seq"]][r["pos"] :] for r in sorted(out, key=lambda r: r["rank"])]
        reach = len(rows) if depth > 1000 else depth // 2
        assert [x[:reach] for x in order] == sorted(x[:reach] for x in order)


def test_no_sequences(spark):
    assert suffix_order(spark.createDataFrame([], "seq long, pos long, sym long, size long"), 100).collect() == []
