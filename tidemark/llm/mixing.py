"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import stored, table

SEED = 17
#: The largest rate that one draw has; a document of a larger rate has several draws, whose sum is again Poisson.
MAX_RATE = 256.0


def hidden_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` starts with, for columns of an operator's own."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def source_rates(
    docs: DataFrame, weights: Mapping[str, float] | None, epochs: float, source_col: str, text_col: str
) -> DataFrame:
    """Rows (source, rate): how often a document of the source is to occur on average.

    A source's size is the sum of its documents' characters, one more for each document, so a
    source of empty texts has a size too.  The rate is the source's share of the weights times
    ``epochs`` times the size of all, divided by the source's size.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(F.length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("double").alias("size")
    )
    if weights is None:
        weight = F.lit(1.0)
    elif weights:
        listed = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        weight = F.when(F.col("source").isNull(), 0.0).otherwise(
            F.coalesce(F.try_element_at(listed, F.col("source")), F.lit(0.0))
        )
    else:
        weight = F.lit(0.0)
    sizes = stored(sizes.withColumn("weight", weight), "sizes")
    total = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total["weight"]:
        return sizes.select("source", F.lit(0.0).alias("rate"))
    return sizes.select(
        "source", (F.lit(float(epochs)) * total["size"] * F.col("weight") / total["weight"] / F.col("size")).alias("rate")
    )


def poisson_steps(rates: DataFrame) -> DataFrame:
    """Rows (source, parts, cdf): the Poisson distribution function at 0, 1, 2, ... of the rate of each of ``parts`` draws.

    A rate over ``MAX_RATE`` is dealt equally over as few draws as keep to it, so no function grows
    with the corpus.  It runs until far beyond the last value that differs from 1 in double
    precision.  Terms are summed as logarithms, so that large rates do not underflow.
    """
    parts = F.greatest(F.ceil(F.col("rate") / MAX_RATE).cast("bigint"), F.lit(1).cast("bigint"))
    rates = rates.where("rate > 0").select("source", parts.alias("parts"), (F.col("rate") / parts).alias("rate"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    by_k = Window.partitionBy("source").orderBy("k")
    terms = rates.select("source", "parts", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    log_step = F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.ln("rate") - F.ln(F.col("k").cast("double")))
    terms = terms.select("source", "parts", "k", F.exp(F.sum(log_step).over(by_k)).alias("p"))
    terms = terms.select("source", "parts", "k", F.sum("p").over(by_k).alias("c"))
    return terms.groupBy("source", "parts").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    epochs: float = 1.0,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Repeats each document a Poisson number of times, so that sources reach target weights.

    ``weights`` maps sources to target shares of the characters; None gives every source the
    same share, and a source that is not listed (or null) gets none.  ``epochs`` is the expected
    size of the result as a multiple of the input.  The number of copies inverts the Poisson
    distribution of the source's rate at a number in [0, 1) hashed from seed and id, so it is the
    same on every run.  A document of a rate over ``MAX_RATE`` has a draw for each part of it; such
    documents are dealt over tasks twice, part by part, before they are copied, so that one that
    stands for a whole source is not copied in one task.  The copies are dealt out by a hash of seed,
    id and copy number and sorted by it within each partition: a global shuffle in one exchange.

    Returns the input's columns and ``copy`` (long, from 0; each further draw numbers its copies from
    the next multiple of its distribution's length) and ``shuffle_key`` (string); input columns of these names are replaced.  Null text counts as empty, null source is a source of
    its own, a null id hashes as the word null, rows that share an id get the same number of
    copies, and an empty table gives an empty one.

    The table of rates has a row for each source.  Spark broadcasts it where the written file is
    below its threshold, and otherwise joins by source, splitting hot sources.
    """
    p = hidden_prefix(docs)
    own = {"copy", "shuffle_key"}
    keep = [c for c in docs.columns if c.lower() not in own]
    steps = stored(poisson_steps(source_rates(docs, weights, epochs, source_col, text_col)), "rates")
    most = steps.agg(F.max("parts")).first()[0] or 1
    steps = steps.select(F.col("source").alias(f"{p}source"), F.col("parts").alias(f"{p}parts"), F.col("cdf").alias(f"{p}cdf"))
    joined = docs.join(steps, F.col(source_col).eqNullSafe(F.col(f"{p}source")), "inner")
    parts = F.col(f"{p}parts")
    once = joined.withColumn(f"{p}part", F.lit(0).cast("bigint"))
    if most > 1:
        # About as many groups of parts as parts in a group: neither step makes very many rows of one.
        size = F.ceil(F.sqrt(parts)).cast("bigint")
        group = F.col(f"{p}group")
        many = joined.where(parts > 1).withColumn(f"{p}group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((parts - 1) / size))))
        many = many.repartition(F.xxhash64(F.col(id_col), group))
        many = many.withColumn(f"{p}part", F.explode(F.sequence(group * size, F.least((group + 1) * size, parts) - 1)))
        many = many.repartition(F.xxhash64(F.col(id_col), F.col(f"{p}part"))).drop(f"{p}group")
        once = once.where(parts == 1).unionByName(many)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    part = F.col(f"{p}part")
    drawn = F.when(part == 0, F.concat_ws(":", F.lit(str(seed)), ident)).otherwise(F.concat_ws(":", F.lit(str(seed)), F.lit("part"), part.cast("string"), ident))
    u = F.conv(F.substring(F.md5(drawn), 1, 13), 16, 10).cast("double") / float(2**52)
    # The number of steps at or below u is the least k whose distribution function exceeds u.
    copies = F.size(F.filter(F.col(f"{p}cdf"), lambda c: c <= F.col(f"{p}u")))
    first = part * F.size(f"{p}cdf")
    copied = (
        once.withColumn(f"{p}u", u).withColumn(f"{p}n", copies)
        .where(F.col(f"{p}n") > 0)
        .select(*keep, F.explode(F.sequence(first, first + F.col(f"{p}n") - 1)).alias("copy"))
    )
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("copy").cast("string")))
    return copied.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed so that each source makes up the same share of the characters."""
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs).select("doc_id", "source", "copy", "shuffle_key", "text")


OP1_SQL = f"""
WITH sizes AS (SELECT source, CAST(sum(length(coalesce(text, '')) + 1) AS DOUBLE) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(size) FROM sizes) / (SELECT count(*) FROM sizes) / size AS rate FROM sizes),
drawn AS (SELECT source, greatest(1, CAST(ceil(rate / {MAX_RATE!r}) AS BIGINT)) AS parts, rate / greatest(1, CAST(ceil(rate / {MAX_RATE!r}) AS BIGINT)) AS rate FROM rates),
ks AS (SELECT source, parts, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM drawn),
ps AS (
  SELECT source, k,
    exp(sum(CASE WHEN k = 0 THEN -rate ELSE ln(rate) - ln(k) END) OVER (PARTITION BY source ORDER BY k)) AS p FROM ks),
steps AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM ps),
lengths AS (SELECT source, parts, count(*) AS steps FROM ks GROUP BY ALL),
parted AS (
  SELECT doc_id, d.source, text, steps, unnest(range(0, parts)) AS part, coalesce(CAST(doc_id AS VARCHAR), 'null') AS ident
  FROM documents d JOIN lengths l ON l.source IS NOT DISTINCT FROM d.source),
hashed AS (
  SELECT doc_id, source, text, steps, part,
    CAST(CAST('0x' || substr(md5(CASE WHEN part = 0 THEN '{SEED}:' || ident ELSE '{SEED}:part:' || CAST(part AS VARCHAR) || ':' || ident END), 1, 13) AS BIGINT) AS DOUBLE)
      / 4503599627370496.0 AS u FROM parted),
counted AS (
  SELECT doc_id, source, text, steps, part,
    (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM h.source AND s.c <= h.u) AS n FROM hashed h),
copied AS (SELECT doc_id, source, text, part * steps + unnest(range(0, n)) AS copy FROM counted)
SELECT doc_id, source, copy,
  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(copy AS VARCHAR)) AS shuffle_key, text FROM copied
"""
