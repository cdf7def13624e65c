"""Marker scans and recounts over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.labels import rate_label
from tamarack.operators import markers
from tamarack.operators.names import name_counts
from tamarack.plans.registry import query, table
from tamarack.sources import spread

# Pieces of words that occur in the test texts; real use passes a watch-list.
WATCH = ("ention", "lichkeit", "zz_marker")


@query(
    "marker_scan",
    """
    SELECT conv_id, turn,
           CAST(contains(text, 'ention') OR contains(text, 'lichkeit') OR contains(text, 'zz_marker') AS INTEGER) AS n_fields,
           concat_ws(',', CASE WHEN contains(text, 'ention') THEN 'ention' END,
                     CASE WHEN contains(text, 'lichkeit') THEN 'lichkeit' END,
                     CASE WHEN contains(text, 'zz_marker') THEN 'zz_marker' END) AS markers
    FROM conversations
    WHERE contains(text, 'ention') OR contains(text, 'lichkeit') OR contains(text, 'zz_marker')
    """,
)
def q_marker_scan(spark: SparkSession, sf: str) -> DataFrame:
    hits = markers.marker_scan(table(spark, sf, "conversations"), ["response", "text"], WATCH)
    return hits.select("conv_id", "turn", "n_fields", F.array_join("markers", ",").alias("markers"))


@query(
    "marker_scan_long",
    """
    WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{6,}'))) AS m FROM documents),
    list AS (SELECT m FROM w ORDER BY md5(m) LIMIT 5000)
    SELECT conv_id, turn, CAST(1 AS INTEGER) AS n_fields, string_agg(m, ',' ORDER BY m) AS markers
    FROM conversations JOIN list ON contains(text, m)
    GROUP BY conv_id, turn
    """,
)
def q_marker_scan_long(spark: SparkSession, sf: str) -> DataFrame:
    """A watch-list of 5,000 words of the documents against all conversations."""
    words = name_counts(table(spark, sf, "documents"), "text", "[A-Za-z]{6,}")
    watch = [r.name for r in words.orderBy(F.md5("name")).limit(5000).collect()]
    hits = markers.marker_scan(spread(table(spark, sf, "conversations"), "conv_id", "turn"), ["text"], watch)
    return hits.select("conv_id", "turn", "n_fields", F.array_join("markers", ",").alias("markers"))


@query(
    "marker_scan_fields",
    """
    SELECT page_id, CAST(contains(url, 'the') AS INTEGER) + CAST(contains(html, 'the') AS INTEGER) AS n_fields
    FROM pages WHERE contains(url, 'the') OR contains(html, 'the')
    """,
)
def q_marker_scan_fields(spark: SparkSession, sf: str) -> DataFrame:
    """A row with hits in two fields is one row."""
    hits = markers.marker_scan(table(spark, sf, "pages"), ["url", "html"], ["the"])
    return hits.select("page_id", "n_fields")


@query(
    "marker_position",
    """
    WITH hit AS (SELECT doc_id, text, left(text, instr(text, 'ention') - 1) AS head FROM documents WHERE contains(text, 'ention')),
    placed AS (SELECT doc_id, text, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS INTEGER) AS line_no FROM hit)
    SELECT doc_id, line_no, CASE WHEN line_no = 1 THEN 'top'
           WHEN line_no = 2 AND starts_with(text, '#!') THEN 'after_shebang' ELSE 'elsewhere' END AS placement
    FROM placed
    """,
)
def q_marker_position(spark: SparkSession, sf: str) -> DataFrame:
    found = markers.marker_position(table(spark, sf, "documents"), "text", "ention")
    return found.select("doc_id", "line_no", "placement")


_PREVALENCE_SQL = """
    SELECT source, lang, count(*) AS n_rows, count(*) FILTER (WHERE hit) AS n_hits,
           round(100.0 * count(*) FILTER (WHERE hit) / count(*), 6) AS rate_pct
    FROM (SELECT source, lang, coalesce(contains(text, 'ention') OR contains(text, 'lichkeit')
          OR contains(text, 'zz_marker'), false) AS hit FROM documents)
    GROUP BY source, lang
"""


@query("marker_prevalence", _PREVALENCE_SQL)
def q_marker_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    found = markers.marker_prevalence(table(spark, sf, "documents"), ["text"], WATCH, ["source", "lang"])
    return found.withColumn("rate_pct", F.round("rate_pct", 6))


@query(
    "marker_prevalence_sampled",
    """
    WITH s AS (SELECT contains(text, 'ention') OR contains(text, 'lichkeit') OR contains(text, 'zz_marker') AS hit
               FROM documents ORDER BY md5('5:' || doc_id) LIMIT 500),
    c AS (SELECT count(*) AS m, count(*) FILTER (WHERE hit) AS k, (SELECT count(*) FROM documents) AS n FROM s),
    p AS (SELECT m, k, n, k / m AS p, 1 + 1.96 * 1.96 / m AS scale FROM c),
    w AS (SELECT *, (p + CAST(3.8416 AS DOUBLE) / (2 * m)) / scale AS centre,
                 sqrt(p * (1 - p) / m + CAST(3.8416 AS DOUBLE) / (4 * m * m)) * 1.96 / scale AS half FROM p)
    SELECT n AS n_rows, m AS n_sampled, k AS sample_hits, k * n // m AS estimated_hits,
           round(100.0 * p, 6) AS rate_pct, round(100 * greatest(centre - half, 0.0), 6) AS low_pct,
           round(100 * least(centre + half, 1.0), 6) AS high_pct
    FROM w
    """,
)
def q_marker_prevalence_sampled(spark: SparkSession, sf: str) -> DataFrame:
    found = markers.marker_prevalence_sampled(
        table(spark, sf, "documents"), ["text"], WATCH, ["doc_id"], seed=5, n=500
    )
    rounded = {c: F.round(c, 6) for c in ("rate_pct", "low_pct", "high_pct")}
    return found.withColumns(rounded)


@query(
    "prevalence_audit",
    """
    WITH c AS (SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE contains(text, 'ention')) AS n_hits
               FROM documents GROUP BY source),
    r AS (SELECT *, 100.0 * n_hits / n_rows AS rate,
                 CAST(CASE source WHEN 'src0' THEN 50.0 WHEN 'src1' THEN 0.5 WHEN 'src2' THEN 0.005 ELSE 20.0 END AS DOUBLE) AS target
          FROM c)
    SELECT source, n_rows, n_hits, round(rate, 6) AS observed_pct, target AS declared_pct,
           round(rate - target, 6) AS gap_pct, abs(rate - target) <= 10 AS as_declared,
           CASE source WHEN 'src0' THEN '50p00' WHEN 'src1' THEN '0p5000' WHEN 'src2' THEN '5p00e-03'
                ELSE '20p00' END AS declared_label
    FROM r
    """,
)
def q_prevalence_audit(spark: SparkSession, sf: str) -> DataFrame:
    found = markers.marker_prevalence(table(spark, sf, "documents"), ["text"], ["ention"], ["source"])
    audit = markers.prevalence_audit(
        found, "source", {"src0": 50.0, "src1": 0.5, "src2": 0.005}, default=20.0, tolerance=10.0
    )
    return audit.withColumns({c: F.round(c, 6) for c in ("observed_pct", "gap_pct")})


@query(
    "rate_label",
    """
    WITH c AS (SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE contains(text, 'ention')) AS k
               FROM documents GROUP BY source, lang),
    x AS (SELECT source, lang, 100.0 * k / n / 1000 AS rate FROM c
          UNION ALL SELECT source || '*', lang, 100.0 * k / n / 10 FROM c),
    e AS (SELECT source, lang, rate, CASE WHEN rate > 0 THEN CAST(floor(log10(rate)) AS INTEGER) ELSE 0 END AS e0 FROM x),
    m AS (SELECT *, rate / pow(10.0, e0) AS m0 FROM e),
    f AS (SELECT source, lang, rate, CASE WHEN round(m0, 2) >= 10 THEN e0 + 1 ELSE e0 END AS ex,
                 CASE WHEN round(m0, 2) >= 10 THEN m0 / 10 ELSE m0 END AS ma FROM m)
    SELECT source, lang, replace(CASE
        WHEN rate < 0.01 THEN CAST(CAST(CAST(ma AS DECIMAL(38,12)) AS DECIMAL(38,2)) AS VARCHAR) || 'e'
             || CASE WHEN ex < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(ex) AS VARCHAR), 2, '0')
        WHEN rate < 1 THEN CAST(CAST(CAST(rate AS DECIMAL(38,12)) AS DECIMAL(38,4)) AS VARCHAR)
        ELSE CAST(CAST(CAST(rate AS DECIMAL(38,12)) AS DECIMAL(38,2)) AS VARCHAR) END, '.', 'p') AS label
    FROM f
    """,
)
def q_rate_label(spark: SparkSession, sf: str) -> DataFrame:
    found = markers.marker_prevalence(table(spark, sf, "documents"), ["text"], ["ention"], ["source", "lang"])
    rows = F.inline(
        F.array(
            F.struct(F.col("source").alias("source"), (F.col("rate_pct") / 1000).alias("rate")),
            F.struct(F.concat("source", F.lit("*")).alias("source"), (F.col("rate_pct") / 10).alias("rate")),
        )
    )
    return found.select("lang", rows).select("source", "lang", rate_label(F.col("rate")).alias("label"))
