"""Line dedup by a line's frequency relative to its site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.mixing import hidden_prefix

MAX_RATIO = 0.02
MIN_PAGES = 2


def _line_key(line: Column) -> Column:
    """128 bits of hash for a line, as a struct of two longs."""
    return F.struct(F.xxhash64(F.lit(1), line).alias("h1"), F.xxhash64(F.lit(2), line).alias("h2"))


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, null where there is none: a ``host_col`` for web pages."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def boilerplate_lines(
    docs: DataFrame, host_col: str, text_col: str, max_ratio: float, min_pages: int
) -> DataFrame:
    """Rows (host, lines): the keys of the lines that too many pages of the host contain.

    Lines that a page repeats count once for it, and pages of equal text of a host are one page,
    so that copies of a page do not make its lines boilerplate.  Counts combine on the map side,
    so a hot host, page or line is no hot task; only hashes of lines are exchanged.  A host with p
    pages of l lines has at most l / max_ratio such lines.
    """
    text = F.col(text_col)
    lines = F.array_distinct(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    keyed = docs.where(text.isNotNull()).select(
        F.col(host_col).alias("host"), F.xxhash64(F.lit(1), text).alias("p1"), F.xxhash64(F.lit(2), text).alias("p2"), F.transform(lines, _line_key).alias("keys")
    )
    once = stored(keyed.groupBy("host", "p1", "p2").agg(F.first("keys").alias("keys")), "pages")
    counted = once.select("host", F.explode("keys").alias("key")).groupBy("host", "key.h1", "key.h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    pages = once.groupBy(F.col("host").alias("page_host")).agg(F.count("*").alias("pages"))
    frequent = counted.join(pages, F.col("host").eqNullSafe(F.col("page_host"))).where(F.col("n") > max_ratio * F.col("pages"))
    return frequent.groupBy("host").agg(F.collect_list(F.struct("h1", "h2")).alias("lines"))


def site_line_dedup(
    docs: DataFrame,
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    host_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Drops lines that more than ``max_ratio`` of the pages of their host contain.

    A line is dropped where another page of the host contains it (at least ``min_pages`` pages in
    all) and their number exceeds ``max_ratio`` times the host's pages.  Pages of equal text count
    as one.  Lines are compared as they are; blank ones are never counted or dropped.

    Returns the input's columns, the text without those lines, and ``n_lines`` and ``n_dropped``
    (int); input columns of these names are replaced.  Null text stays null with 0 lines, an
    empty text is one blank line, null hosts form one host, repeated rows count as one page and
    are all kept, a page that loses all lines keeps its row, and an empty table gives an empty one.

    The keys of a host's dropped lines are one array, bounded by its lines a page over
    ``max_ratio``.  Spark broadcasts that table where it is below its threshold and otherwise
    joins by host, splitting hot hosts; texts are never regrouped.
    """
    p = hidden_prefix(docs)
    own = {"n_lines", "n_dropped"}
    keep = [c for c in docs.columns if c.lower() not in own]
    found = stored(boilerplate_lines(docs, host_col, text_col, max_ratio, min_pages), "lines")
    found = found.select(F.col("host").alias(f"{p}host"), F.col("lines").alias(f"{p}drop"))
    joined = docs.join(found, F.col(host_col).eqNullSafe(F.col(f"{p}host")), "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.when(
        F.col(f"{p}drop").isNull(), lines
    ).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(f"{p}drop"), _line_key(x))))
    out = joined.select(*keep, lines.alias(f"{p}lines"), kept.alias(f"{p}kept"))
    n = F.coalesce(F.size(f"{p}lines"), F.lit(0))
    n = F.when(F.col(f"{p}lines").isNull(), 0).otherwise(n)
    n_kept = F.when(F.col(f"{p}kept").isNull(), 0).otherwise(F.size(f"{p}kept"))
    return out.select(
        *[F.array_join(f"{p}kept", "\n").alias(c) if c == text_col else F.col(c) for c in keep],
        n.alias("n_lines"),
        (n - n_kept).alias("n_dropped"),
    )


def op4_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that more than 2 % of their source's documents contain."""
    docs = table(spark, sf_dir, "documents")
    return site_line_dedup(docs).select("doc_id", "n_lines", "n_dropped", "text")


OP4_SQL = f"""
WITH lined AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
once AS (SELECT DISTINCT source, lines FROM lined WHERE lines IS NOT NULL),
pages AS (SELECT source, count(*) AS pages FROM once GROUP BY source),
counted AS (
  SELECT source, line, count(*) AS n
  FROM (SELECT source, unnest(list_distinct(lines)) AS line FROM once) WHERE trim(line) <> '' GROUP BY source, line),
dropped AS (
  SELECT c.source, list(c.line) AS lines FROM counted c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source
  WHERE c.n >= {MIN_PAGES} AND c.n > {MAX_RATIO} * p.pages GROUP BY c.source),
kept AS (
  SELECT l.doc_id, l.lines,
    CASE WHEN d.lines IS NULL THEN l.lines ELSE list_filter(l.lines, lambda x: NOT list_contains(d.lines, x)) END AS kept
  FROM lined l LEFT JOIN dropped d ON l.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS INTEGER) AS n_lines,
  CAST(coalesce(len(lines) - len(kept), 0) AS INTEGER) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM kept
"""
