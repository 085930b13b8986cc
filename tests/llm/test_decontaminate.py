import random

from tablewash.llm.decontaminate import contained_items, drop_contaminated


def _cut(text):
    words = "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if c.isascii() else c for c in text or "").split(" ")
    words = [w for w in words if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _expected(docs, items):
    out = set()
    for i, t in docs:
        own = _cut(t)
        for k, q in items:
            want = _cut(q)
            if want and 10 * len(own & want) >= 8 * len(want):
                out.add((i, k, len(own & want), len(want)))
    return out


def _tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, item_id string, n int").repartition(3),
        spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, doc_id int"),
    )


def test_against_all_pairs(spark):
    pick = random.Random(4)
    words = ["The", "of", "ÉTÉ", "blue", "runs,", "a", "stone", "wind", "of", "and"]
    items = [(k, " ".join(pick.choices(words, k=pick.randint(3, 70)))) for k in range(30)]
    docs = []
    for i in range(150):
        own = pick.choices(words, k=pick.randint(2, 400))
        if i % 3:
            passage = items[i % 30][1].upper().split(" ")
            for _ in range(pick.randint(0, 3)):
                passage[pick.randrange(len(passage))] = "CHANGED"
            at = pick.randrange(len(own))
            own[at:at] = passage
        docs.append((i, pick.choice([" ", "\n"]).join(own)))
    left, right = _tables(spark, docs, items)
    for bits in (22, 6):  # few bits: many false hits, same answer
        out = contained_items(left, right, bits=bits).collect()
        found = {(r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in out}
        assert len(out) == len(found) and found == _expected(docs, items)
    bad = {i for i, *_ in _expected(docs, items)}
    kept = drop_contaminated(left, right)
    assert kept.columns == left.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _ in docs if i not in bad]


def test_edges(spark):
    items = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, "short Item")]
    docs = [(None, "x one two three FOUR five six y"), (5, "SHORT item"), (5, "SHORT item"), (6, None), (7, ""), (8, "short item now"), (9, "w " * 200_000 + "one two three four five six")]
    left, right = _tables(spark, docs, items)
    found = sorted(((r["doc_id"] or 0), r["item_id"]) for r in contained_items(left, right).collect())
    assert found == [(0, 1), (5, 4), (9, 1)]
    assert sorted(r["doc_id"] for r in drop_contaminated(left, right).collect()) == [6, 7, 8]
    assert contained_items(left, right.limit(0)).collect() == [] and contained_items(left.limit(0), right).collect() == []
    assert drop_contaminated(left, right.limit(0)).count() == 7
