"""Line dedup by frequency within a site.

Pages are grouped by host; a line's frequency is the number of the host's pages that
hold it, divided by the host's page total. Lines over ``RATIO`` that are on at least
``MIN_PAGES`` pages are boilerplate of that host and are dropped there.

Lines are compared without white space at their ends, by MD5; lines that are blank
are never boilerplate. Counting is a plain aggregation by host and digest with partial
sums before the shuffle. What exceeds the ratio is a short list for each host (a page
of average length has few lines, and each listed line takes up ``RATIO`` of a host's
pages), kept as one array, written, and joined to the documents: broadcast if under
Spark's threshold, else shuffled with skewed hosts split.

Defined results: a null text stays null; a null host is a host of its own; a page that
consists of boilerplate becomes empty; repeated rows count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactspark.llm.common import DOCUMENT_COLUMNS, free_prefix, materialise, table

RATIO = 0.1
MIN_PAGES = 5
#: Space, tab, carriage return, form feed and vertical tab at a line's ends don't count.
_TRIMMED = r"btrim(x, ' \t\r\f\u000b')"


def _digests(text: str) -> str:
    """SQL: the digests of a text's lines that aren't blank."""
    return f"transform(filter(transform(split({text}, '\\n', -1), x -> {_TRIMMED}), x -> x != ''), x -> unhex(md5(x)))"


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, lines (array of digests) of the hosts that have boilerplate."""
    pages = docs.select(F.col(host_col).alias("host"), F.expr(f"array_distinct({_digests(f'`{text_col}`')})").alias("lines"))
    counts = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = materialise(docs.groupBy(F.col(host_col).alias("page_host")).agg(F.count(F.lit(1)).alias("pages")), "line-totals")
    often = counts.join(totals, F.col("host").eqNullSafe(F.col("page_host"))).where(F.col("n") > ratio * F.col("pages"))
    return materialise(often.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines")), "line-boilerplate")


def drop_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` without boilerplate lines, and ``n_lines`` and ``n_dropped`` (in place of columns of these names)."""
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    p = free_prefix(docs, "_line")
    listed = boilerplate(docs, host_col, text_col, ratio, min_pages).select(F.col("host").alias(f"{p}_host"), F.col("lines").alias(f"{p}_boilerplate"))
    df = docs.join(listed, F.col(f"`{host_col}`").eqNullSafe(F.col(f"{p}_host")), "left")
    df = df.withColumn(f"{p}_all", F.expr(f"split(`{text_col}`, '\\n', -1)"))
    stays = f"filter({p}_all, x -> {_TRIMMED} = '' OR NOT array_contains({p}_boilerplate, unhex(md5({_TRIMMED}))))"
    df = df.withColumn(f"{p}_kept", F.when(F.col(f"{p}_boilerplate").isNull(), F.col(f"{p}_all")).otherwise(F.expr(stays)))
    size = lambda x: F.when(F.col(x).isNull(), 0).otherwise(F.size(x)).cast("long")
    text = F.array_join(f"{p}_kept", "\n").alias(text_col)
    return df.select(*[text if c == text_col else F.col(f"`{c}`") for c in kept], size(f"{p}_all").alias("n_lines"), (size(f"{p}_all") - size(f"{p}_kept")).alias("n_dropped"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_chars, kept_md5 of every document; the host is its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = drop_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


OP7_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, source, text FROM documents),
lines AS (
  SELECT row_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM docs),
keyed AS (SELECT row_id, source, line, pos, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS bare FROM lines),
often AS (
  SELECT c.source, c.bare FROM
    (SELECT source, bare, count(DISTINCT row_id) AS n FROM keyed WHERE bare != '' GROUP BY ALL) c
    JOIN (SELECT source, count(*) AS pages FROM docs GROUP BY source) t ON c.source IS NOT DISTINCT FROM t.source
  WHERE n >= {MIN_PAGES} AND n > {RATIO}::DOUBLE * pages),
marked AS (SELECT k.*, o.bare IS NOT NULL AS gone FROM keyed k LEFT JOIN often o ON k.source IS NOT DISTINCT FROM o.source AND k.bare = o.bare),
texts AS (
  SELECT row_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY row_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(kept) AS kept_chars, md5(kept) AS kept_md5
FROM docs LEFT JOIN texts USING (row_id)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its source's boilerplate lines dropped and n_chars brought up to date."""
    out = drop_lines(docs.select(*DOCUMENT_COLUMNS))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
