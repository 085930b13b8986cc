import itertools
import random
import re

import pytest

from tablewash.llm.line_crf import ALL_CONTENT, LineModel, fit, label_lines, line_features, line_labels, repeated_words, split_lines, train, viterbi

_CLASS = re.compile(r"[^\x20\x09-\x0D]+")


def test_viterbi_is_the_best_path():
    pick = random.Random(1)
    for _ in range(200):
        n = pick.randint(1, 7)
        scores = [pick.uniform(-2, 2) for _ in range(n)]
        model = LineModel(0, (), (pick.uniform(-1, 1), pick.uniform(-1, 1)), tuple(tuple(pick.uniform(-1, 1) for _ in "ab") for _ in "ab"))

        def total(path, scores=scores, model=model):
            moves = sum(model.moves[a][b] for a, b in zip(path, path[1:]))
            return model.start[path[0]] + moves + sum(s for s, y in zip(scores, path, strict=True) if y)

        best = max(itertools.product((False, True), repeat=n), key=total)
        assert total(viterbi(scores, model)) == pytest.approx(total(best))
    assert viterbi([], ALL_CONTENT) == []


def _counts(text):
    """The counts, each from its definition."""
    text = text or ""
    words = _CLASS.findall(text)
    lines = [x for x in text.split("\n") if _CLASS.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again),
        len(words) < 50 or 100 * len(again) > 50 * len(words),
    )


def _texts():
    pick = random.Random(5)
    words = ["the", "É b", "x#", "a|b", "end.", "of", "To", " wide", "<p>"]
    out = [pick.choice(["\n", " ", "\t"]).join(pick.choices(words, k=pick.randint(0, 120))) for _ in range(60)]
    return out + [None, "", " \n\x0b", "a\nb\na\na \n", "w " * 70, "one two three " * 40, "line of words here\n" * 30, "x" * 200_000]


def test_counts_and_verdicts(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, "null id", 1), (1, texts[1], 2)], "doc_id bigint, text string, n_words int")
    out = label_lines(docs, ALL_CONTENT).collect()
    assert len(out) == len(texts) + 2
    by = {r["doc_id"]: r for r in out}
    for i, t in enumerate(texts):
        r = by[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _counts(t)
        assert r["kept"] == (not r["base_failed"])
    assert label_lines(docs.limit(0), ALL_CONTENT).collect() == []
    many = [f"{i}".encode() for i in range(30)] * 2
    assert repeated_words(many) == 60


def test_held_out_lines():
    pick = random.Random(2)

    def sequence(good):
        lines = []
        for _ in range(pick.randint(1, 12)):
            words = [pick.choice([b"ember", b"fjord", b"grove"]) for _ in range(pick.randint(3, 14))]
            if not good:
                words = [w + b"###" if pick.random() < 0.9 else w for w in words]
            line = b" ".join(words) + b"."
            lines.append(line_features(line, line.split(), False))
        return lines, good

    model = fit([sequence(i % 2 == 0) for i in range(200)])
    right = total = 0
    for masks, good in [sequence(i % 2 == 0) for i in range(200)]:
        labels = viterbi([model.emission(m) for m in masks], model)
        right += sum(y == good for y in labels)
        total += len(labels)
    assert right > 0.98 * total
    assert fit([]) == fit([([1, 2], True)]) == ALL_CONTENT


def test_trained_on_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.filter("doc_id % 2 = 0"))
    judged = label_lines(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in judged) > 0.97 * len(judged) > 0
    assert train(docs, labels.limit(0)) == ALL_CONTENT


def test_lines():
    words, masks, again = split_lines("a b\n\n  \nc\na b\na b ".encode())
    assert [len(w) for w in words] == [2, 1, 2, 2] and again == 1 and len(masks) == 4


def test_lines_of_mixed_documents_are_told_apart():
    pick = random.Random(3)

    def line(junk):
        words = [pick.choice([b"ember", b"fjord", b"grove", b"isle"]) for _ in range(pick.randint(5, 14))]
        text = b" | ".join(words) if junk else b" ".join(words) + b"."
        return line_features(text, text.split(), False)

    def mixed(junk_lines, lines):
        runs = [True] * junk_lines + [False] * (lines - junk_lines)
        if pick.random() < 0.5:
            runs.reverse()
        return [line(j) for j in runs], [not j for j in runs]

    def documents(n):
        for i in range(n):
            lines = pick.randint(2, 12)
            good = i % 2 == 0
            masks, gold = mixed(0 if good else pick.randint((lines + 1) // 2, lines), lines)
            yield masks, good, gold

    train_set = list(documents(300))
    # A very long document is learnt from as a whole.
    train_set.append(([line(False) for _ in range(400)], True, [True] * 400))
    assert [list(x) for x in line_labels([(m, y) for m, y, _ in train_set])] == [g for _, _, g in train_set]
    model = fit([(m, y) for m, y, _ in train_set])
    right = total = sequences = 0
    for masks, _, gold in documents(300):
        labels = viterbi([model.emission(m) for m in masks], model)
        right += sum(a == b for a, b in zip(labels, gold, strict=True))
        total += len(gold)
        sequences += len(set(labels)) > 1
    assert right > 0.98 * total and sequences > 60


def test_half_of_a_bad_document_is_boilerplate():
    good = [([1, 2, 2], True)] * 5
    assert [x.tolist() for x in line_labels([*good, ([1, 2, 4, 2], False), ([2], False), ([4, 4, 4, 2], False)])[5:]] == [
        [True, False, False, True], [False], [False, False, False, True],
    ]


def test_shares_on_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    named = docs.selectExpr("concat('d', doc_id) AS doc_id", "text"), labels.selectExpr("concat('d', doc_id) AS doc_id", "quality")
    shares = [r["content_share"] for r in label_lines(docs, train(*named)).collect() if r["n_lines"] > 1]
    assert sum(0 < s < 1 for s in shares) > 20
