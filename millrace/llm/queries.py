"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontam import contamination_report
from millrace.llm.langid import identify_languages
from millrace.llm.near_dups import near_duplicate_classes
from millrace.llm.negatives import mine_hard_negatives
from millrace.llm.neighbours import nearest
from millrace.llm.pages import extract_pages
from millrace.llm.passages import repeated_passages
from millrace.llm.pieces import encode_documents
from millrace.llm.pii import find_documents
from millrace.llm.prefixes import conversation_trie
from millrace.llm.scoring import score_documents
from millrace.llm.sharding import shard_documents
from millrace.llm.wordpiece import count_tokens

SHARDS = 24

#: Distances are summed component by component, as the operator does, so that scores are equal.
OP1_SQL = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    min(sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b))) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
  GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""


#: Windows are joined as texts of their words; a document's hit words are the distinct places in its hit windows.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS gram FROM (SELECT *, unnest(range(len(w) - n + 1)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM grams),
places AS (SELECT row_no, n, i, array_to_string(w[i + 1 : i + n], ' ') AS gram FROM (SELECT row_no, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT row_no, n, i, item FROM places JOIN grams USING (n, gram)),
found AS (SELECT row_no, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY ALL),
hit_words AS (SELECT row_no, count(DISTINCT place) AS n_hit FROM (SELECT row_no, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT row_no, n, i FROM hits)) GROUP BY ALL)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN found USING (row_no) LEFT JOIN hit_words USING (row_no)
"""


#: All pairs of anchors and rows.
OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)),
positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""


#: The CRC-32 of an id is folded from its digits, bit by bit; a node is the list of its turns.
OP13_SQL = """
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, substr(sha256(length(r) || ':' || r || x), 1, 32)) AS t FROM turns GROUP BY conv_id),
hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 9 AS h FROM own),
built AS (SELECT a.conv_id, list_concat(coalesce(b.t[1 : a.h], []), a.t[a.h + 1 :]) AS t FROM hashed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
members AS (SELECT conv_id, t[1 : d] AS p, d, len(t) = d AS ends FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM built)),
nodes AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends FROM members GROUP BY p, d),
children AS (SELECT p[1 : d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (p)),
subtrees AS (
  SELECT p, count(*) FILTER (n_children = 0) AS n_leaves, sum(CASE WHEN d > 0 THEN (n - 1) * strlen(x) ELSE 0 END)::BIGINT AS saved_tokens
  FROM (SELECT p[1 : a] AS p, n, d, x, n_children FROM (SELECT *, p[d].x AS x, unnest(range(d + 1)) AS a FROM whole)) GROUP BY p)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n AS n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends AS ends_sha256
FROM whole w JOIN subtrees s USING (p) LEFT JOIN nodes u ON w.d > 0 AND u.p = w.p[1 : w.d - 1]
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors.where(F.col("vec_id") % 100 == 0), vectors, 10)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(_table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece tokens of every document."""
    return count_tokens(_table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find_documents(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that repeat across documents."""
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, with parity and the round trip."""
    return encode_documents(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows not held out."""
    return identify_languages(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 24, its slot there, and its shard among 25."""
    return shard_documents(_table(spark, sf_dir, "documents"), SHARDS)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, after the label of every seventh is moved by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learned from the rows not held out."""
    return score_documents(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": op1_ann,
        "op2_html_extraction": op2_html_extraction,
        "op3_token_counts": op3_token_counts,
        "op4_minhash_dedup": op4_minhash_dedup,
        "op5_decontamination": op5_decontamination,
        "op6_pii": op6_pii,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_language_id": op9_language_id,
        "op10_sharding": op10_sharding,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_lm_scoring": op12_lm_scoring,
        "op13_prefix_trie": op13_prefix_trie,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ann": OP1_SQL, "op5_decontamination": OP5_SQL, "op11_hard_negatives": OP11_SQL, "op13_prefix_trie": OP13_SQL}
