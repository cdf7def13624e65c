"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import (
    bpe,
    decontaminate,
    jaccard,
    pii,
    prefix_trie,
    quality,
    quality_rules,
    substrings,
    toxicity,
    warc,
    whitening,
)
from tamarack.llm import exact_dedup as dedup
from tamarack.llm import url_filters as urls
from tamarack.llm.labelled import held_out
from tamarack.plans.registry import table
from tamarack.session import fresh_path, ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


@query(
    "op2_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
        FROM documents
    )
    SELECT doc_id,
           first_value(doc_id) OVER w AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           row_number() OVER w = 1 AS kept,
           text_sha256,
           length(t) AS n_chars
    FROM d
    WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id)
    """,
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query(
    "op5_url_filters",
    r"""
    WITH u AS (
        SELECT page_id, row_number() OVER () AS k,
               CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages
    ), p AS (
        SELECT page_id, k,
               translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
        FROM u
    ), r (rule_host, rule_path, rule_verdict) AS (
        VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
               ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
    ), m AS (
        SELECT k, rule_host || rule_path AS rule, rule_verdict,
               row_number() OVER (PARTITION BY k ORDER BY length(rule_host || rule_path) DESC,
                                  length(rule_host) DESC, rule_verdict DESC) AS place
        FROM p JOIN r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host))
                     AND starts_with(p.path, rule_path)
    )
    SELECT page_id, host, path, m.rule AS rule, coalesce(m.rule_verdict, 'allow') AS verdict
    FROM p LEFT JOIN m ON p.k = m.k AND m.place = 1
    """,
)
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), spark.sql(urls.RULES))


def encoded_documents(docs: DataFrame) -> DataFrame:
    """Ids of every whole text and the bytes decoded from them, as digests."""
    import public_tokenizers

    spark = docs.sparkSession
    shared = bpe.share(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = bpe.encode(docs.select("doc_id", "text"), shared, packed=True, decoded=True)
    return ids.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents"))


@query(
    "op4_warc",
    """
    WITH d AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
        FROM pages
    ), f AS (
        SELECT *, CASE WHEN payload_bytes >= 100
                       THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
        FROM d
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM f
    """,
)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    warc.write_archives(warc.resolve_revisits(table(spark, sf_dir, "pages")), path)
    records = warc.read_archives(spark, path).where("gap IS NULL")
    kind = warc.header("WARC-Type")
    response = kind == "response"
    return records.select(
        warc.header("X-Page-ID").cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(warc.header("X-Payload-Length")).cast("long")
        .alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256))
        .otherwise(F.substring_index(warc.header("WARC-Payload-Digest"), ":", -1))
        .alias("payload_digest"),
        kind.alias("record_type"),
        warc.header("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
    )


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.col("toxic"))
    scored = docs.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        toxicity.score_column(F.col("text"), model, spark).alias("score"),
    )
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


# The labels hold two grades, 0 and 1; a document is selected if it reaches grade 1 with this probability.
GRADES, REACH, SELECT_FROM = 2, 1, 0.8


def graded_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a struct ``grade``: expected grade, tail probability, selected."""
    spark = docs.sparkSession
    model = quality.train(docs, labels, F.col("quality"), GRADES)
    own = quality.grade_columns(F.col("text"), model, REACH, spark)
    graded = docs.select(F.struct(*docs.columns).alias("row"), own.alias("grade"))
    return graded.withColumn("selected", F.col("grade.tail_probability") >= SELECT_FROM)


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    graded = graded_documents(docs, table(spark, sf_dir, "labels"))
    return graded.select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        "grade.expected_grade",
        "grade.tail_probability",
        "selected",
    )


@query(
    "op8_jaccard",
    r"""
    WITH RECURSIVE t AS (
        SELECT doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), g AS (
        SELECT DISTINCT doc_id,
               unnest(CASE WHEN len(w) >= 5
                           THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM t
    ), n AS (
        SELECT doc_id, count(s) AS n FROM (SELECT doc_id FROM documents) LEFT JOIN g USING (doc_id) GROUP BY doc_id
    ), shared AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM g AS x JOIN g AS y USING (s)
        WHERE x.doc_id <> y.doc_id GROUP BY 1, 2
    ), links AS (
        SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
        WHERE 100 * m >= 75 * (x.n + y.n - m)
    ), reached AS (
        SELECT doc_id AS id, doc_id AS root FROM n
        UNION
        SELECT b, root FROM reached JOIN links ON a = id
    )
    SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id
    FROM n JOIN reached ON id = n.doc_id
    GROUP BY n.doc_id, n.n
    """,
)
def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


@query("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_substrings")
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.with_classes(substrings.repeated_passages(table(spark, sf_dir, "documents")))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.train(docs))
    counts = [f"n_{kind}" for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query("op12_quality_rules")
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.judge_quality(docs, labels, F.col("quality"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_embeddings(table(spark, sf_dir, "embeddings"))


@query(
    "op11_prefix_trie",
    r"""
    WITH RECURSIVE t AS (
        SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x
        FROM conversations
        WHERE conv_id IS NOT NULL
    ), o AS (
        SELECT c, list(struct_pack(r := r, x := x)
                       ORDER BY turn NULLS FIRST, substr(sha256(length(r) || ':' || r || x), 1, 32)) AS own
        FROM t
        GROUP BY c
    ), z (c, step, v) AS (
        SELECT c, 0, 4294967295 FROM o
        UNION ALL
        SELECT c, step + 1,
               CASE WHEN (b & 1) = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END
        FROM (SELECT c, step, CASE WHEN step % 8 = 0 THEN xor(v, ascii(substr(c::VARCHAR, (step // 8 + 1)::INT, 1)))
                                   ELSE v END AS b
              FROM z WHERE step < 8 * length(c::VARCHAR)) AS s
    ), h AS (
        SELECT c, (xor(v, 4294967295) % 4)::INT AS h FROM z WHERE step = 8 * length(c::VARCHAR)
    ), rebuilt AS (
        SELECT o.c, list_concat(coalesce(p.own[1:h], []), o.own[h + 1:]) AS s
        FROM o JOIN h ON o.c = h.c LEFT JOIN o AS p ON p.c = o.c - o.c % 20
    ), member AS (
        SELECT c, unnest(range(0, len(s) + 1)) AS d, s FROM rebuilt
    ), prefix AS (
        SELECT c, d, s[1:d] AS k, s[1:d - 1] AS up, len(s) = d AS ends, CASE WHEN d > 0 THEN s[d].x ELSE '' END AS x
        FROM member
    ), node AS (
        SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(x) AS x,
               sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS e
        FROM prefix GROUP BY d, k
    ), full_node AS (
        SELECT a.d, a.k, a.c, a.n, a.e, b.c AS parent, coalesce(m.n, 0) AS n_children,
               (a.n - 1) * len(regexp_extract_all(a.x, '[^\x20\x09-\x0D]+')) AS saved
        FROM node AS a
        LEFT JOIN node AS b ON b.d = a.d - 1 AND b.k = a.up
        LEFT JOIN (SELECT d - 1 AS d, up, count(*) AS n FROM node GROUP BY 1, 2) AS m ON m.d = a.d AND m.up = a.k
    )
    SELECT v.c AS conv_id, v.d AS depth, any_value(v.parent) AS parent_conv_id, any_value(v.n) AS n_convs,
           any_value(v.n_children) AS n_children, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves,
           sum(u.saved)::BIGINT AS saved_tokens, any_value(v.e) AS ends_sha256
    FROM full_node AS v JOIN full_node AS u ON u.d >= v.d AND u.k[1:v.d] = v.k
    GROUP BY v.c, v.d, v.k
    """,
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))
