"""Quality classifier: a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

THRESHOLD = 0.3
#: Share of the pooled covariance in each class's, and of the scaled identity in that.
POOLED, IDENTITY = 0.3, 0.05

FEATURES = (
    "word_length", "space", "upper", "digit", "stop", "comma", "mark", "symbol", "bar", "wide",
    "line_words", "shouted", "plain", "distinct", "repeated", "top_word", "same_lines",
)

_CLASSES = {
    "space": b" \t\n\r\x0b\x0c",
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "stop": b".",
    "comma": b",;:",
    "mark": b"!?",
    "symbol": b"#$%&*+=<>@^~_\\{}[]",
    "bar": b"|/",
    "wide": bytes(range(128, 256)),
}


def statistics(texts) -> np.ndarray:
    """One row of transformed statistics for each text (null: as empty).

    Shares enter as log((count + 1/2) / (total + 1)), so that empty texts have values too, and a
    few odd characters of a long text weigh little.
    """
    member = np.zeros((256, len(_CLASSES)))
    for k, chars in enumerate(_CLASSES.values()):
        member[list(chars), k] = 1
    out = np.empty((len(texts), len(FEATURES)))

    def share(n: float, of: float) -> float:
        return float(np.log((n + 0.5) / (of + 1)))

    for i, text in enumerate(texts):
        text = text or ""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        counts = np.bincount(raw, minlength=256) @ member
        words = text.split()
        n = len(words)
        seen: dict[str, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        lines = [x for x in text.split("\n") if x]
        repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
        out[i] = (
            np.log((len(text) + 1) / (n + 1)),
            *(share(c, len(raw)) for c in counts),
            np.log((n + 1) / (len(lines) + 1)),
            share(sum(map(str.isupper, words)), n),
            share(sum(map(str.isalpha, words)), n),
            share(len(seen), n) / np.log(n + 3),  # distinct words grow with a power of the words
            share(repeated, n),
            share(max(seen.values(), default=0), n),
            share(len(lines) - len(set(lines)), len(lines)),
        )
    return out


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors and log weights of the two classes, over standardised statistics."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # class, feature
    inverse_factors: np.ndarray  # class, feature, feature: the inverse of the Cholesky factor
    log_weights: np.ndarray  # class: log prior less half the log determinant

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row of statistics."""
        z = (x - self.center) / self.scale
        logs = [w - 0.5 * np.square((z - m) @ f.T).sum(1) for m, f, w in zip(self.means, self.inverse_factors, self.log_weights, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def _partial_sums(batches):
    """Count, sums and sums of products of the statistics, by class."""
    import pyarrow as pa

    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        for c in (0, 1):
            own = x[y == c]
            sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(list(sums), pa.list_(pa.float64()))], names=["y", "sums"])


def fit(labelled: DataFrame, pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant:
    """Fits the discriminant to rows (y int 0 or 1, features array<double>), all of them.

    Sums of products are made within each task and added up by Spark; what comes to the driver is
    two rows of each sum, however many rows there are.  Each class's covariance is shrunk towards
    the pooled one and that towards a scaled identity, so it can be inverted for few rows too.
    A class without rows takes the other's mean and the pooled covariance; without any labels
    every score is 1/2.
    """
    d = len(FEATURES)
    parts = labelled.select("y", "features").mapInArrow(_partial_sums, "y bigint, sums array<double>")
    rows = parts.select("y", F.posexplode("sums").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, 1 + d + d * d))
    for y, i, v in rows:
        sums[y, i] = v
    n, s, p = sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d)
    if not n.sum():
        eye = np.stack([np.eye(d)] * 2)
        return Discriminant(np.zeros(d), np.ones(d), np.zeros((2, d)), eye, np.zeros(2))
    center = s.sum(0) / n.sum()
    spread = p.sum(0) / n.sum() - np.outer(center, center)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
    means = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], center)
    own = p / np.maximum(n, 1)[:, None, None] - np.einsum("ki,kj->kij", means, means)
    own = own / np.outer(scale, scale) * (n[:, None, None] > 0)
    within = (n[:, None, None] * own).sum(0) / n.sum()
    factors, weights = [], []
    for c in (0, 1):
        cov = (1 - pooled) * own[c] + pooled * within if n[c] else within
        cov = (1 - identity) * cov + identity * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(factor))
        weights.append(np.log((n[c] + 1) / (n.sum() + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(center, scale, (means - center) / scale, np.stack(factors), np.array(weights))


def with_features(docs: DataFrame, text_col: str = "text") -> Column:
    """The statistics of each text, as a column of arrays."""

    @F.pandas_udf("array<double>")
    def features(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(list(statistics(texts.tolist())))

    return features(docs[text_col])


def quality_score(model: Discriminant, features: Column) -> Column:
    """The score of a column of statistics, from 0 to 1."""

    @F.pandas_udf("double")
    def score(x):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(model.scores(np.stack(x.to_list()))) if len(x) else pd.Series([], dtype=float)

    return score(features)


def text_score(model: Discriminant, text: Column) -> Column:
    """The score of a column of texts, from 0 to 1; statistics and score in one step."""

    @F.pandas_udf("double")
    def score(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(model.scores(statistics(texts.tolist()))) if len(texts) else pd.Series([], dtype=float)

    return score(text)


#: Most labelled documents that the filter's fit learns from; their ids take 8 bytes each.
MAX_LABELLED = 20_000


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from the fit: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(label_id, y) of the labels that may be learned from: 0 or 1, with an id, not held out."""
    return labels.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("y")
    )


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features) of all documents, written to the shared folder."""
    return stored(docs.select(F.col(id_col).alias("doc_id"), with_features(docs, text_col).alias("features")), "features")


def fit_on(features: DataFrame, labels: DataFrame, **how) -> Discriminant:
    """Fits to the rows of a feature table that have learnable labels (each label row counts)."""
    known = learnable(labels)
    return fit(features.join(known, features["doc_id"] == known["label_id"]).select("y", "features"), **how)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose quality score is ``threshold`` or more, with all their columns.

    The fit takes the labels of at most ``max_labelled`` documents, those of least hash of their
    ids; the ids are sent to all tasks, so that no text is exchanged, and only these documents'
    statistics are computed for it.  The filter scores all documents.  Null and empty texts have a score too; null ids never match a
    label; repeated rows are scored alike; an empty table gives an empty one.
    """
    known = learnable(labels).select("label_id").distinct().orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    labelled = docs.select(id_col, text_col).join(F.broadcast(known), F.col(id_col) == F.col("label_id"), "left_semi")
    model = fit_on(feature_table(labelled, id_col, text_col), labels)
    return docs.where(text_score(model, docs[text_col]) >= threshold)


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from the labels that are not held out."""
    features = feature_table(table(spark, sf_dir, "documents"))
    model = fit_on(features, table(spark, sf_dir, "labels"))
    scored = features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(model, F.col("features")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
