import zlib

from tablewash.llm.sharding import histogram_shards

SCHEMA = "doc_id bigint, text string, size int, shard string"


def _run(spark, rows, shards, **more):
    frame = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA).repartition(5)
    return histogram_shards(frame, shards, **more).collect()


def _bytes(out, shards):
    return [sum(r["size"] for r in out if r["shard"] == s) for s in range(shards)]


def _slots_are_gapless(out):
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    return all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sizes_are_near_equal_and_rows_whole(spark):
    rows = [(i, "word " * (i * 7919 % 97) + "é") for i in range(3000)]
    out = _run(spark, rows, 7, rows_per_bucket=100)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sorted(
        (i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in rows
    )
    assert {r["law"] for r in out} == {"bytes"} and {r["grown_shard"] for r in out} == {None}
    sizes = _bytes(out, 7)
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 7 + 2 * 520
    assert _slots_are_gapless(out)


def test_one_text_and_one_row_may_fill_the_table(spark):
    rows = [(i, "the same text") for i in range(600)] + [(5, "again") for _ in range(600)] + [(i, f"t{i}") for i in range(600)]
    out = _run(spark, rows, 8, rows_per_bucket=50)
    assert len(out) == 1800 and _slots_are_gapless(out)
    sizes = _bytes(out, 8)
    assert max(sizes) - min(sizes) <= 200


def test_equal_texts_are_neighbours(spark):
    rows = [(i, f"text {i % 40}") for i in range(2000)]
    out = _run(spark, rows, 4)
    spread = {}
    for r in out:
        spread.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in spread.values()) <= 3


def test_edges(spark):
    assert _run(spark, [], 4) == []
    out = _run(spark, [(None, None), (1, ""), (1, ""), (2, "x" * 300_000)], 40)
    assert len(out) == 4 and _slots_are_gapless(out)
    assert sorted(r["size"] for r in out) == [16, 16, 16, 300_016]
    assert [r["text_crc32"] for r in out if r["size"] == 16] == [0, 0, 0]


def test_slots_follow_the_key_at_every_size(spark):
    rows = [(i, f"text {i % 927}" if i % 3 else "hot") for i in range(3000)]
    few = {r["doc_id"]: (r["shard"], r["slot"]) for r in _run(spark, rows, 4, rows_per_bucket=10**6)}
    many = _run(spark, rows, 4, rows_per_bucket=10)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in many} == few
    for shard in range(4):
        texts = [r["text_crc32"] for r in sorted((r for r in many if r["shard"] == shard), key=lambda r: r["slot"])]
        assert sum(a != b for a, b in zip(texts, texts[1:])) + 1 == len(set(texts))
