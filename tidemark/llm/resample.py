"""Importance resampling toward a target's word features, counted once for each distinct line."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import partitions, stored, table

GRAM, BUCKETS, PERCENT, MIN_WORDS, SEED = 1, 10_000, 10, 20, 2024
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A to Z in lower case.

    A line feed is no part of a word, so a text's words are those of its lines in turn.
    """
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def _runs(words_: Column, lengths: range) -> Column:
    """All runs of consecutive words of the given lengths, joined by a space."""
    def of(n: int) -> Column:
        starts = F.when(F.size(words_) >= n, F.sequence(F.lit(1), F.size(words_) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words_, i, n), " "))

    return words_ if list(lengths) == [1] else F.concat(*[of(n) for n in lengths])


def _key(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(7), line).alias("k2")]


def segments(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, id, at, line): each document's lines that hold more than blanks; one row with a null line for a document without any.

    ``row`` numbers the documents' rows, so that rows of one id stay apart.  The table of numbered
    rows must be written before it is read twice (``stored``): numbers may differ in another run.
    """
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return d.select("row", "id", F.posexplode_outer(F.split("text", "\n", -1)).alias("at", "line"))


def line_features(lines: DataFrame, gram: int, buckets: int) -> DataFrame:
    """(k1, k2, times, found, head, tail, short): the buckets of each distinct line's features, and how often the line occurs.

    ``head`` and ``tail`` are its first and last ``gram`` - 1 words, and ``short`` is its number of
    words if that is less than ``gram`` - 1, for the features that reach over line ends.
    """
    distinct = lines.where("line is not null").groupBy("line").agg(F.count("*").alias("times"))
    cut = distinct.select(*_key(F.col("line")), "times", words(F.col("line")).alias("w"))
    w = F.col("w")
    out = cut.select("k1", "k2", "times", F.transform(_runs(w, range(1, gram + 1)), lambda f: _bucket(f, buckets)).alias("found"), F.size("w").alias("n"), *([] if gram == 1 else [
        F.slice(w, 1, gram - 1).alias("head"), F.when(F.size(w) >= gram - 1, F.slice(w, -(gram - 1), gram - 1)).otherwise(w).alias("tail"),
    ]))
    return out.where("n > 0")


def crossing(refs: DataFrame, lines: DataFrame, gram: int, buckets: int) -> DataFrame:
    """(row, bucket): features of two words or more that reach over a line end, one row each.

    For each line that has words, the ``gram`` - 1 words before it in its document are put before
    its own first ``gram`` - 1: runs that begin in the former and end in the latter cross.  Words
    before come from at most ``gram`` - 1 earlier lines, as every line kept has one at least.
    """
    if gram == 1:
        return refs.select("row", F.lit(0).alias("bucket")).limit(0)
    known = refs.join(lines.select("k1", "k2", "head", "tail"), ["k1", "k2"])
    before = Window.partitionBy("row").orderBy("at").rowsBetween(-(gram - 1), -1)
    past = F.flatten(F.collect_list("tail").over(before))
    m = gram - 1
    past = F.when(F.size(past) > m, F.slice(past, -m, m)).otherwise(past)
    both = known.select("row", past.alias("past"), "head").where(F.size("past") > 0)
    features = []
    for n in range(2, gram + 1):
        # A run of n words that begins i words before the line end, 1 <= i < n, and ends n - i words after it.
        for i in range(1, n):
            ok = (F.size("past") >= i) & (F.size("head") >= n - i)
            features.append(F.when(ok, F.array_join(F.concat(F.slice("past", -i, i), F.slice("head", 1, n - i)), " ")))
    return both.select("row", F.explode(F.array_compact(F.array(*features))).alias("f")).select("row", _bucket(F.col("f"), buckets).alias("bucket"))


def bucket_counts(lines: DataFrame, crossed: DataFrame) -> DataFrame:
    """(bucket, n): features of all occurrences of all lines, and those over line ends."""
    inside = lines.select("times", F.explode("found").alias("bucket")).groupBy("bucket").agg(F.sum("times").alias("n"))
    return inside.union(crossed.groupBy("bucket").agg(F.count("*").alias("n"))).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """floor(1000 ln(share in the target / share in the own corpus)) of each bucket, each share smoothed by one.

    ``own`` and ``target`` are tables of at most ``buckets`` rows, which come to the driver.
    """
    s, t = [0] * buckets, [0] * buckets
    for counts, df in ((s, own), (t, target)):
        for r in df.collect():
            counts[r.bucket] = r.n
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return [math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)]


def _counted(texts: DataFrame, gram: int, buckets: int, name: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The numbered references of rows to lines, the distinct lines, the crossing features and the bucket counts."""
    cut = segments(texts, *texts.columns)
    refs = stored(cut.select("row", "id", "at", *[F.when(F.col("line").isNotNull(), k).alias(n) for k, n in zip(_key(F.col("line")), ("k1", "k2"), strict=True)]), f"{name}-refs")
    lines = stored(line_features(cut.select("line"), gram, buckets), f"{name}-lines")
    crossed = crossing(refs, lines, gram, buckets)
    return refs, lines, crossed, bucket_counts(lines, crossed)


def importance(docs: DataFrame, target: DataFrame, gram: int = GRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Each document's importance weight and its Gumbel-perturbed score.

    ``docs`` has doc_id and text, ``target`` text; other columns are not read.  Returns, per row of
    ``docs``: row, doc_id, n_words, n_features, weight, score.  Features are all runs of 1 to ``gram``
    words, repeats counted.  Texts are cut at line feeds, which words never hold; the features of
    each distinct line are counted once, and count as often as the line occurs.  Features of several
    words that reach over line ends are added for each document.

    A null or empty text has no features and weight 0.  A null doc_id hashes as the empty string.
    Repeated rows count each, in the corpus's counts too.  Empty tables count as no features.
    Distinct lines are exchanged once with their text; documents are joined with lines by a hash of
    128 bits, where Spark may split a line that most documents hold.
    """
    refs, lines, crossed, own = _counted(docs.select("doc_id", "text"), gram, buckets, "corpus")
    wanted = _counted(target.select(F.lit(0).alias("doc_id"), "text"), gram, buckets, "target")[3]
    gain = gains(own, wanted, buckets)
    table_ = F.lit(gain)
    weigh = lambda found: F.aggregate(found, F.lit(0).cast("bigint"), lambda a, b: a + F.element_at(table_, b + 1))
    weights = stored(lines.select("k1", "k2", F.col("n").cast("bigint").alias("n"), F.size("found").cast("bigint").alias("f"), weigh(F.col("found")).alias("w")), "line-weights")
    joined = refs.join(weights, ["k1", "k2"], "left")
    parts = joined.select("row", "id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("f", F.lit(0)).alias("f"), F.coalesce("w", F.lit(0)).alias("w"))
    over = crossed.select("row", F.lit(None).cast(refs.schema["id"].dataType).alias("id"), F.lit(0).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("f"), F.element_at(table_, F.col("bucket") + 1).cast("bigint").alias("w"))
    every = parts if gram == 1 else parts.unionAll(over)
    summed = every.groupBy("row").agg(F.max("id").alias("doc_id"), F.sum("n").alias("n_words"), F.sum("f").alias("n_features"), F.sum("w").alias("weight"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return summed.withColumn("score", (F.col("weight") + noise).cast("bigint"))


def ranked(scored: DataFrame, chosen: Column, drawn: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """Adds ``rank``: 1, 2, 3 ... by falling score, ties by rising ``tie``, of the ``drawn`` best ``chosen`` rows, else null.

    Rows are dealt out by range of score and numbered within their partition; the partitions' sizes
    give where each begins.  The numbered rows are written, so that their numbers stay.
    """
    spark = scored.sparkSession
    order = [F.desc(score), F.asc_nulls_last(tie), F.asc("row")]
    some = scored.where(chosen)
    sorted_ = some.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    numbered = stored(sorted_.withColumn("number", F.monotonically_increasing_id()), "ranked")
    part, at = F.shiftright("number", 33), F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.p, r.n) for r in numbered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    begins, total = {}, 0
    for p, n in sizes:
        begins[p] = total
        total += n
    if begins:
        begin = F.element_at(F.create_map(*[F.lit(int(x)) for pair in begins.items() for x in pair]), part.cast("int"))
        rank = at + begin + 1
        numbered = numbered.withColumn("rank", F.when(rank <= drawn, rank.cast("bigint"))).drop("number")
    else:
        numbered = numbered.withColumn("rank", F.lit(None).cast("bigint")).drop("number")
    rest = scored.where(~F.coalesce(chosen, F.lit(False))).withColumn("rank", F.lit(None).cast("bigint"))
    return numbered.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, gram: int = GRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Draws ``percent`` percent of the documents of ``min_words`` words or more by importance, without replacement.

    Returns ``importance``'s columns and ``rank``, which is null for documents that are not drawn.
    The drawn documents are those of the highest scores, which is a draw by weight, since the scores'
    noise is Gumbel.
    """
    scored = stored(importance(docs, target, gram, buckets, seed), "scored")
    chosen = F.col("n_words") >= min_words
    n = scored.where(chosen).count()
    return ranked(scored, chosen, percent * n // 100)


def op11_segment_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight toward the benchmark's features, its score, and its rank if drawn."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"""
OP11_SQL = f"""
WITH crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(0, 256) g(i))),
texts AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, 0, 0, text FROM benchmark),
w AS MATERIALIZED (SELECT side, r, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}')) AS w FROM texts),
n AS MATERIALIZED (SELECT side, r, w, count(*) AS n FROM w GROUP BY ALL),
d AS MATERIALIZED (SELECT w, xor({_CRC}, 4294967295) % {BUCKETS} AS b FROM (SELECT DISTINCT w, hex(encode(w)) AS h FROM n) CROSS JOIN crc),
k AS (SELECT b, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM n JOIN d USING (w) GROUP BY b),
g AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS}) / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})))) AS BIGINT) AS gain FROM k),
x AS (SELECT r, sum(n) AS f, sum(n * gain) AS weight FROM n JOIN d USING (w) JOIN g USING (b) WHERE side = 0 GROUP BY r),
y AS (SELECT r, doc_id, CAST(coalesce(f, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM texts LEFT JOIN x USING (r) WHERE side = 0),
z AS (SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score, n_features >= {MIN_WORDS} AS chosen FROM y),
q AS (SELECT *, CASE WHEN chosen THEN row_number() OVER (PARTITION BY chosen ORDER BY score DESC, doc_id) END AS p, count(*) FILTER (chosen) OVER () AS k FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= {PERCENT} * k // 100 THEN p END AS rank FROM q
"""
