"""Registered queries of the corpus operators, each next to the SQL that must give its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm import (
    decontaminate,
    licenses,
    mixing,
    ngram_join,
    packing,
    pii,
    token_counts,
    topk,
    toxicity,
    trie,
    warc,
    whitening,
    wrappers,
)
from burnish.llm.common import written

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || left(md5('mix' || chr(31) || coalesce(doc_id::VARCHAR, '')), 15))::BIGINT AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w
  FROM totals),
levels AS (
  SELECT *, (SELECT sum(source_size) FROM weighed) AS words, (SELECT sum(w) FROM weighed) AS ws,
         coalesce(sum(2 * source_size) OVER o, 0) AS held, coalesce(sum(w) OVER o, 0) AS used
  FROM weighed
  WINDOW o AS (ORDER BY 2 * source_size / w, source IS NULL, source
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT coalesce(max((words * 1.5 - held) / (ws - used)) FILTER
                  (2 * source_size / w >= (words * 1.5 - held) / (ws - used)), 0)::DOUBLE AS l
  FROM levels),
targets AS (
  SELECT source, source_size, least(2 * source_size::DOUBLE, w * l) AS target
  FROM weighed, level),
placed AS (
  SELECT s.*, source_size, target,
         floor(target / greatest(source_size, 1))::BIGINT AS epochs,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id NULLS FIRST, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT
         AS taken
FROM placed
"""


@register("op1_source_mix", MIX_SQL)
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = written(mixing.sized(table(spark, folder, "documents")), "mix-sizes")
    mixed = mixing.apply_plan(docs, mixing.plan_mix(docs))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@register("op2_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents").select("doc_id", "text"))\
        .drop("text")


@register("op3_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = wrappers.extract_main(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
      FROM scored)
WHERE rank <= 5
"""


@register("op4_top_vectors", TOP_SQL)
def top_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@register("op5_toxicity")
def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))
    return found.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "toxic_spans",
    )


@register("op6_benchmark_matches")
def benchmark_matches(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


@register("op7_token_lengths")
def token_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.length_histogram(table(spark, folder, "documents"))


@register("op8_personal_data")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.named(base), 256).alias("base_sha256"),
        pii.named(F.col("spans")).alias("spans"),
    )


WARC_SQL = """
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest,
         octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM (SELECT *, payload_bytes >= 100 AND first IS NOT NULL
                AND first IS DISTINCT FROM page_id AS again FROM f)
"""


@register("op9_warc_round_trip", WARC_SQL)
def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    back = warc.round_trip(table(spark, folder, "pages"))
    sound = F.when(F.col("fault").isNull(), F.col("record_type")).otherwise(
        F.raise_error(F.concat(F.lit("damaged record: "), F.col("fault")))
    )
    return back.select(
        "page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to"
    )


@register("op10_near_duplicates")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


TRIE_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(
             string_split(conv_id::VARCHAR, ''),
             lambda c: list_prepend(ascii(c)::BIGINT, list_transform(range(8), lambda i: -1))))),
           lambda x, s: CASE WHEN s >= 0 THEN xor(x, s)
                             ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
paths AS (
  SELECT c.conv_id, 0 AS part, t.pos, role, text
  FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, role, text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
whole AS (
  SELECT c.conv_id,
         coalesce(list(md5(length(role) || ':' || role || text) ORDER BY part, pos)
                  FILTER (pos IS NOT NULL), []) AS keys,
         coalesce(list(length(text) ORDER BY part, pos) FILTER (pos IS NOT NULL), []) AS chars
  FROM convs c LEFT JOIN paths p ON p.conv_id = c.conv_id GROUP BY c.conv_id),
steps AS (
  SELECT conv_id, d AS depth, keys[1:d] AS node, CASE WHEN d > 0 THEN keys[1:d - 1] END AS parent,
         CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars, d = len(keys) AS last
  FROM (SELECT *, unnest(range(len(keys) + 1)) AS d FROM whole)),
nodes AS (
  SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         any_value(chars) AS chars,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends
  FROM steps GROUP BY node, depth),
children AS (SELECT parent, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
counted AS (
  SELECT v.*, coalesce(c.n, 0) AS n_children
  FROM nodes v LEFT JOIN children c ON c.parent = v.node),
sums AS (
  SELECT node[1:d] AS node, sum((n_children = 0)::INT) AS n_leaves,
         sum((n_convs - 1) * chars) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted) GROUP BY ALL)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs,
       v.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM counted v JOIN sums s ON s.node = v.node LEFT JOIN nodes p ON p.node = v.parent
"""


@register("op11_prefix_trie", TRIE_SQL)
def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(table(spark, folder, "conversations")).drop("n_ends")


@register("op13_packed_sequences")
def packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    found = packing.pack(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


@register("op12_whitened_vectors")
def whitened_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
