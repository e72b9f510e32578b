"""Queries of the corpus operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seepage.llm import (
    decontaminate, embeddings, language, line_dedup, packing, prefix_trie, sharding, simhash, token_counts, token_files,
    toxicity, warc, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, distance=3)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@_query
def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"), 0.98)


ORACLES["op3_embeddings"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON r.other = l.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a) USING (vec_id)
JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) USING (vec_id)"""


@_query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's count before and after three edits that follow from its id and text."""
    docs = _table(spark, sf_dir, "documents").withColumn("edits", token_counts.derived_edits())
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.counts(token_counts.apply_edits(token_counts.trees(docs, path, keep=("edits",)), path))


@_query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.without_repeats(_table(spark, sf_dir, "documents")))


@_query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )


@_query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@_query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(
        decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op7_decontamination"] = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i : i + 9] AS words
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT len(words) AS n FROM win),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM doc),
hit AS (SELECT doc_id, p, n, item_id FROM place, size, win
        WHERE p + n - 1 <= len(w) AND len(win.words) = n AND w[p : p + n - 1] = win.words),
inside AS (SELECT doc_id, count(DISTINCT x) AS n_hit
           FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN inside USING (doc_id) LEFT JOIN items USING (doc_id)"""


@_query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_table(spark, sf_dir, "documents"))


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"), 16)


@_query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), 32)


@_query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(sha1(html), {1 + 10 * g}, 10) AS BIGINT)"
    f" >> {35 - 5 * i}) & 31), 1)" for g in range(4) for i in range(8))

ORACLES["op12_warc"] = f"""
WITH page AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
last AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS kept FROM page)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM last"""


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations")).drop("ref_conv", "ref_pos")


_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''),
        lambda x: CAST(ascii(x) AS BIGINT))), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
        lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))"""

ORACLES["op13_prefix_trie"] = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p,
        dense_rank() OVER (ORDER BY role, text) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
size AS (SELECT c, count(*) AS n FROM t GROUP BY c),
conv AS (SELECT size.c, size.c - size.c % 20 AS b, h, least(h, coalesce(s.n, 0)) AS own
    FROM (SELECT c, {_CRC32} % 4 AS h FROM size) x JOIN size USING (c) LEFT JOIN size s ON s.c = size.c - size.c % 20),
turn AS (SELECT conv.c, p AS d, k, w FROM conv JOIN t ON t.c = b AND p <= h
    UNION ALL SELECT conv.c, p - h + own, k, w FROM conv JOIN t ON t.c = conv.c AND p > h),
seq AS (SELECT conv.c, list(k ORDER BY d) FILTER (k IS NOT NULL) AS s, list(w ORDER BY d) FILTER (k IS NOT NULL) AS w
    FROM conv LEFT JOIN turn ON turn.c = conv.c GROUP BY conv.c),
prefix AS (SELECT c, d, coalesce(s[1:d], []) AS s, CASE WHEN d = 0 THEN 0 ELSE w[d] END AS w, d = coalesce(len(s), 0) AS ends
    FROM (SELECT *, unnest(range(0, coalesce(len(s), 0) + 1)) AS d FROM seq)),
node AS (SELECT s, d, min(c) AS owner, count(*) AS n_convs, any_value(w) AS w,
    string_agg(CASE WHEN ends THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends FROM prefix GROUP BY s, d),
path AS (SELECT c, d, owner FROM prefix JOIN node USING (s, d)),
placed AS (SELECT node.owner, node.d, path.owner AS parent, n_convs, w, ends
    FROM node LEFT JOIN path ON path.c = node.owner AND path.d = node.d - 1),
child AS (SELECT parent AS owner, d - 1 AS d, count(*) AS n FROM placed WHERE d > 0 GROUP BY ALL),
counted AS (SELECT placed.*, coalesce(n, 0) AS n_children FROM placed LEFT JOIN child USING (owner, d)),
below AS (SELECT path.owner, path.d, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved
    FROM counted JOIN path ON path.c = counted.owner AND path.d <= counted.d GROUP BY ALL)
SELECT owner AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM counted JOIN below USING (owner, d)"""
