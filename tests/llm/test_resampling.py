import math
import random

import numpy as np
from pyspark.sql import functions as F

from tablewash.llm import resampling
from tablewash.llm.common import nth_smallest


def _tables(spark, n=400):
    pick = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        good = i % 5 != 0
        words = pick.choices("alder birch cedar dune ember fjord".split(), k=pick.randint(5, 60))
        if not good:
            words = [w.upper() + "##" for w in words]
        docs.append((i, " ".join(words), "x", 0.5))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, kept string, log_weight double").repartition(4),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_ratio_against_plain_counts(spark):
    docs, labels = _tables(spark)
    target = labels.filter("quality = 1")
    models = resampling.fit(docs, target, bits=10)
    chosen = {r["doc_id"] for r in target.collect()}
    raw, good = np.zeros(1024), np.zeros(1024)
    for r in docs.collect():
        for g in resampling.grams(r["text"].encode(), 10):
            raw[g] += 1
            good[g] += r["doc_id"] in chosen
    base = (raw + 1) / (raw.sum() + 1024)
    expected = np.log((good + base * 1024) / (good.sum() + 1024) / base)
    assert np.allclose(models.ratio, expected)


def test_top_k_is_exact_and_follows_the_target(spark):
    docs, labels = _tables(spark)
    for share in (0.0, 0.3, 0.8, 1.0):
        out = resampling.resample(docs, labels, bits=12, share=share).collect()
        order = sorted(out, key=lambda r: -r["gumbel_key"])
        k = math.ceil(share * len(out))
        assert {r["doc_id"] for r in out if r["kept"]} == {r["doc_id"] for r in order[:k]}
        for r in out:
            assert r["gumbel_key"] == r["log_weight"] + resampling.gumbel(r["doc_id"], 42)
    out = resampling.resample(docs, labels, bits=12).collect()
    assert sum(r["kept"] == (r["doc_id"] % 5 != 0) for r in out) > 0.9 * len(out)
    kept = resampling.keep_sampled(docs, labels, bits=12)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in out if r["kept"])


def test_selection_and_order(spark):
    pick = random.Random(1)
    values = [pick.choice([-1, 1]) * 10 ** pick.randint(-300, 300) for _ in range(300)] + [0.0, -0.0, math.inf, -math.inf, 5e-324]
    keys = [resampling.sortable(v) for v in values]
    assert [values[i] for i in np.argsort(keys, kind="stable")] == sorted(values)
    frame = spark.createDataFrame([(k,) for k in keys + keys[:50]], "k long").repartition(3)
    every = sorted(keys + keys[:50])
    for n in (1, 2, 150, len(every)):
        assert nth_smallest(frame, "k", n)[0] == every[n - 1]
    assert nth_smallest(frame, "k", len(every) + 1) is None
    assert nth_smallest(frame.filter("k is null"), "k", 1) is None


def test_edges(spark):
    docs, labels = _tables(spark, 30)
    odd = spark.createDataFrame([(None, None, "x", 0.0), (None, "", "y", 0.0), (99, "e" * 300_000, "z", 0.0), (99, "e" * 300_000, "z", 0.0)], docs.schema)
    out = resampling.resample(docs.union(odd), labels).collect()
    assert len(out) == 34
    twins = [r for r in out if r["doc_id"] == 99]
    assert twins[0] == twins[1]
    assert all(r["kept"] and r["log_weight"] == 0 for r in resampling.resample(docs, labels.limit(0)).collect())
    assert resampling.resample(docs.limit(0), labels).collect() == []
    assert resampling.keep_sampled(docs.limit(0), labels).collect() == []
    assert resampling.good_share(labels.withColumn("quality", F.lit(None).cast("int"))) == 1.0
