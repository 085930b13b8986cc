"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewash.llm import decontaminate, doubling, line_crf, page_model, resampling, simhash_trie, suffix_dedup, viterbi_pieces
from tablewash.llm.collocations import collocations
from tablewash.llm.filter_audit import failure_masks, filter_audit, text_filters
from tablewash.llm.packing import pack_documents
from tablewash.llm.sharding import histogram_shards
from tablewash.llm.url_filters import filter_urls

#: The rules that the url query applies.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
SHARDS = 40
#: Where the tokenizer's file lies; TOKENIZER_FILE overrides it.
PIECES = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/piece_bpe_32k.model")
#: The same for the packed ids; BYTE_TOKENIZER_FILE overrides it.
BYTE_TOKENIZER = os.environ.get("BYTE_TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.remove_repeated_windows(_table(spark, sf_dir, "documents")).drop("kept")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(_table(spark, sf_dir, "documents")).drop("kept")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(_table(spark, sf_dir, "pages"), rules)


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_crf.label_lines(docs, line_crf.train(docs, _table(spark, sf_dir, "labels")))


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_model.extract_pages(_table(spark, sf_dir, "pages"), page_model.trained())


def op8_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(_table(spark, sf_dir, "documents"), SHARDS)


def op9_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op10_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi_pieces.encode_texts(_table(spark, sf_dir, "documents"), PIECES)


def op11_filter_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    filters = text_filters(docs["text"])
    return filter_audit(failure_masks(docs, _table(spark, sf_dir, "labels"), filters), [*filters, "E"])


def op12_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents")).drop("path", "place")


def op13_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_table(spark, sf_dir, "documents"), BYTE_TOKENIZER)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_trie": op1_simhash_trie,
    "op2_level_doubling": op2_level_doubling,
    "op3_suffix_array": op3_suffix_array,
    "op4_url_filters": op4_url_filters,
    "op5_line_crf": op5_line_crf,
    "op6_importance_resampling": op6_importance_resampling,
    "op7_page_tree": op7_page_tree,
    "op8_histogram_shards": op8_histogram_shards,
    "op9_minhash_containment": op9_minhash_containment,
    "op10_streaming_viterbi": op10_streaming_viterbi,
    "op11_filter_diagrams": op11_filter_diagrams,
    "op12_phrase_graph": op12_phrase_graph,
    "op13_tiered_packing": op13_tiered_packing,
}

#: Words as all operators here cut them.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _five_words(table: str, key: str) -> str:
    words = _WORDS.format(_LOWER.format("coalesce(text, '')"))
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i+4], ' ') AS g
      FROM (SELECT {key}, {words} AS w FROM {table}) x, unnest(range(1, greatest(2, len(w) - 3))) AS t(i) WHERE len(w) > 0"""


#: All orders of five letters.
_ORDERS = """SELECT a || b || c || d || e AS filter_order
  FROM (SELECT unnest(string_split('A,B,C,D,E', ',')) AS a), (SELECT unnest(string_split('A,B,C,D,E', ',')) AS b),
    (SELECT unnest(string_split('A,B,C,D,E', ',')) AS c), (SELECT unnest(string_split('A,B,C,D,E', ',')) AS d),
    (SELECT unnest(string_split('A,B,C,D,E', ',')) AS e)
  WHERE len(list_distinct([a, b, c, d, e])) = 5"""

ORACLES: dict[str, str] = {
    "op11_filter_diagrams": f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents
), firsts AS (SELECT x, min(doc_id) AS least FROM t GROUP BY x
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), w AS (SELECT t.*, {_WORDS.format("x")} AS words FROM t
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN least < w.doc_id THEN 'E' ELSE '' END) AS fails
  FROM w JOIN firsts USING (x) LEFT JOIN l ON l.doc_id = w.doc_id
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails
), steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS f, filter_order[1:step-1] AS before
  FROM ({_ORDERS}) o, unnest(range(1, 6)) AS s(step)
), r AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN translate(fails, before || f, '') = fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
""",
    "op12_phrase_graph": rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, array_to_string(w[i:i+k-1], ' ') AS g, k, count(*) AS f
  FROM w, unnest(range(1, len(w) + 1)) AS t(i), unnest(range(1, 6)) AS s(k)
  WHERE i + k - 1 <= len(w)
  GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT lang, g, k, f FROM f WHERE k > 1 AND NOT EXISTS (
    SELECT 1 FROM f AS q WHERE q.lang = f.lang AND q.f = f.f AND q.k > f.k AND contains(' ' || q.g || ' ', ' ' || f.g || ' '))
), cuts AS (
  SELECT lang, g, f AS a, j, array_to_string(string_split(g, ' ')[1:j], ' ') AS one, array_to_string(string_split(g, ' ')[j+1:], ' ') AS two
  FROM c, unnest(range(1, k)) AS u(j)
), scored AS (
  SELECT cuts.lang, cuts.g AS phrase, a, x.f AS l, y.f AS r, n,
    CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score, j
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.g = one JOIN f AS y ON y.lang = cuts.lang AND y.g = two JOIN n ON n.lang = cuts.lang
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM worst QUALIFY rank <= 2000
""",
    "op2_level_doubling": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS t(i)
), m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g
), gone AS (
  SELECT DISTINCT s.doc_id, s.i + k AS p FROM s JOIN m USING (g), unnest(range(0, 13)) AS o(k) WHERE m.least < s.doc_id
), kept AS (
  SELECT x.doc_id, string_agg(x.v, ' ' ORDER BY x.p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d) x ANTI JOIN gone USING (doc_id, p)
  GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
""",
    "op9_minhash_containment": f"""
WITH d AS ({_five_words("documents", "doc_id")}
), q AS ({_five_words("benchmark", "item_id")}
), n AS (SELECT item_id, count(*) AS item_shingles FROM q GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, item_shingles, count(*) / item_shingles AS containment
FROM d JOIN q USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, item_shingles
HAVING 10 * count(*) >= 8 * item_shingles
""",
    "op4_url_filters": r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(h, p, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), urls AS (SELECT DISTINCT host, path FROM parts
), best AS (
  SELECT u.host, u.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS verdict
  FROM urls u JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
  GROUP BY u.host, u.path
)
SELECT t.page_id, t.host, t.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts t LEFT JOIN best b ON t.host = b.host AND t.path = b.path
""",
}
