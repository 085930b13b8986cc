import itertools
import random
import re

import pytest

from tablewash.llm.filter_audit import MaskDiagram, adjacent_swaps, audit_part, failure_masks, filter_audit, text_filters

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _fails(docs):
    out = []
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = ""
        f += "A" if len(w) < 200 else ""
        f += "B" if 100 * len(set(w)) < 50 * len(w) else ""
        f += "C" if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else ""
        f += "D" if re.search(r"[#$%&*|]", t) else ""
        f += "E" if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else ""
        out.append((i, source or "", set(f)))
    return out


def _expected(docs, labels, letters="ABCDE"):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows, removed_by = [], {}
    failed = _fails(docs)
    for part in sorted({s for _, s, _ in failed}):
        own = [(i, f) for i, s, f in failed if s == part]
        for order in itertools.permutations(letters):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                every = sum(letter in f for _, f in own)
                removed_by[part, letter] = removed_by.get((part, letter), 0) + len(gone)
                rows.append(
                    [part, "".join(order), step, len(left), len(gone), every - len(gone), sum(f == {letter} for _, f in own),
                     sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), letter]
                )
    return sorted((*r[:-1], removed_by[r[0], r[-1]]) for r in rows)


def _run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, mask int, n string, `a.b` int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    filters = text_filters(d["text"])
    out = filter_audit(failure_masks(d, marks, filters), [*filters, "E"])
    assert out.columns == COLUMNS
    return sorted(tuple(r) for r in out.collect())


def _docs(pick, n=90):
    words = ["a", "b", "Cc", "dDD", "é", "e#", "f", "g|", *[f"w{i}" for i in range(300)]]
    docs = []
    for i in range(n):
        few = pick.random() < 0.4
        text = " ".join(pick.choices(words[: 6 if few else None], k=pick.choice([0, 1, 5, 199, 200, 201, 260])))
        if docs and pick.random() < 0.3:
            text = pick.choice(docs)[1]
        docs.append((i, text, pick.choice(["x", "y", "", None])))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_against_every_order_by_hand(spark, seed):
    pick = random.Random(seed)
    docs = _docs(pick)
    docs += [(200, None, "x"), (3, "", "y"), (None, "", "x"), (None, "A " * 250, None), (None, "A " * 250, "x")]
    docs += [docs[4], docs[4], docs[7]]  # repeated rows
    labels = [(i, pick.choice([0, 1, None]), pick.choice([0, 1, None])) for i in range(0, 60, 2)] + [(None, 1, 1), (999, 1, 1)]
    got = _run(spark, [(*d, 0, "n", 1) for d in docs], labels)
    assert got == _expected(docs, labels)


def test_all_copies_and_empty_tables(spark):
    docs = [(i, "same Text", "one" if i else "two") for i in range(40)]
    assert _run(spark, [(*d, 0, "n", 1) for d in docs], []) == _expected(docs, [])
    assert _run(spark, [], [(1, 1, 1)]) == []


@pytest.mark.parametrize("n", range(1, 7))
def test_adjacent_swaps_reach_every_order_once(n):
    order = list(range(n))
    seen = {tuple(order)}
    for at in adjacent_swaps(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(range(n))))


def test_diagram_shares_equal_nodes_and_survives_swaps():
    masks = {m: (m.bit_count(), 1, 0) for m in range(16)}
    diagram = MaskDiagram(masks, 4)
    # The counts depend on the number of failures only, so a level needs one node for each number.
    assert diagram.nodes() == [1, 2, 3, 4]
    for at in adjacent_swaps(4):
        diagram.swap(at)
        assert diagram.nodes() == [1, 2, 3, 4]
        assert diagram.weight(diagram.root) == (32, 16, 0)


def test_one_filter_and_bad_names(spark):
    assert list(audit_part({0: (3, 1, 0), 1: (2, 0, 1)}, ["Z"])) == [("Z", 1, 3, 2, 0, 2, 0, 1, 2)]
    masks = spark.createDataFrame([("p", 1, 2, 0, 0)], "part string, mask int, n long, good long, toxic long")
    for names in ([], ["A", "A"], list("ABCDEFGH")):
        with pytest.raises(ValueError):
            filter_audit(masks, names)


def test_string_ids(spark):
    d = spark.createDataFrame([("b", "t", "s"), ("a", "t", "s")], "doc_id string, text string, source string")
    marks = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    rows = filter_audit(failure_masks(d, marks, {}), ["E"]).collect()
    assert [tuple(r) for r in rows] == [("s", "E", 1, 1, 1, 0, 1, 1, 0, 1)]
