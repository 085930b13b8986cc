import corpus_pipeline
from pyspark.sql import functions as F
from tablewash.llm import queries
from tablewash.llm.common import stored

FOLDER = "/root/testdata/sf0.001"


def _shingles(text, n):
    words = text.lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_stages_on_the_smallest_tables(spark):
    from test_simhash_trie import _groups, _plain

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_strings", "decontamination", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stored(stage(spark, docs, FOLDER), f"test-{name}")
        if name == "tokens":
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after and set(after) <= set(before)
        if name == "quality":
            gone = [i for i in before if i not in after and i in labels]
            assert all(labels[i] == 0 for i in gone) and gone
        elif name == "near_duplicates":
            ids = sorted(before)
            groups = _groups([_plain(before[i]) for i in ids])
            assert set(after) == {ids[g] for g in groups}
        elif name == "repeated_strings":
            raw = {i: t.encode() for i, t in before.items()}
            count, n = {}, corpus_pipeline.PASSAGE_BYTES
            for t in raw.values():
                for k in range(len(t) - n + 1):
                    count[t[k : k + n]] = count.get(t[k : k + n], 0) + 1
            for i, t in raw.items():
                whole = len(t) < n or max(count[t[k : k + n]] for k in range(len(t) - n + 1)) == 1
                assert (after[i] == before[i]) == whole
        elif name == "decontamination":
            for i, t in before.items():
                own = _shingles(t, 5)
                held = any(10 * len(own & q) >= 8 * len(q) > 0 for q in (_shingles(x, 5) for x in items))
                assert (i in after) == (not held)
    assert docs.filter("not round_trip").count() == 0
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(after)


def test_registered(spark):
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, empty, FOLDER)
        assert out.columns == empty.columns and out.count() == 0


def test_odd_rows_pass(spark):
    rows = [(None, None, "en", None, None, 1), (1, "", None, "s", 0, 2), (1, "", None, "s", 0, 2), (2, "a b c " * 40, "en", "s", 7, 3), (3, "w" * 9000, "en", "s", 9000, 4)]
    clashing = ["fp", "_i", "_f", "_id", "_hash", "_runs", "_copied", "a.b", "one", "gone_id", "Digest"]
    docs = spark.createDataFrame(
        [(*r, *range(len(clashing) - 1)) for r in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in clashing),
    )
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), f"odd-{name}")
        if name != "tokens":
            assert docs.columns == columns
    assert docs.agg(F.min("round_trip")).first()[0] in (True, None)
