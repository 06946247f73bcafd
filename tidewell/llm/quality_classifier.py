"""Quality scores by random Fourier features and ridge regression.

Every whole text gives some statistics. Cosines of random projections approximate
a Gaussian kernel over them; each partition sums its part of the normal equations,
and the sums, whose size depends on the number of features alone, are solved for
the ridge weights. Isotonic calibration makes probabilities of the raw scores.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import isotonic
from tidewell.llm.common import discard, materialize, table, text_batches, text_slices

#: Random features, width of the kernel over standardised statistics, ridge penalty a labelled row.
N_FEATURES, WIDTH, PENALTY = 192, 2.5, 1e-3
SEED = 11
STATISTICS = ("log_words", "log_chars", "distinct", "adjacent", "top", "top_line", "dup_lines", "mean_word", "long_words", "symbols", "pipes", "punctuation", "digits", "capitals", "letters", "per_line", "compressed")
CHARS = {"symbols": re.compile(r"[#*$%&<>{}\[\]\\/=+~^_@]"), "punctuation": re.compile(r"[.,;:!?]"), "digits": re.compile(r"\d")}
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
LETTERS = re.compile(r"[^\W\d_]")
#: Text is compressed in parts of this size, and the parts' sizes are summed.
PART = 1 << 16


def statistics(text: str) -> list[float]:
    """The STATISTICS of a whole text; all are 0 for text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, chars = len(words), len(text)
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    of_line = Counter(lines)
    raw = text.encode("utf-8", "surrogatepass")
    squeezed = sum(len(zlib.compress(raw[at : at + PART], 1)) for at in range(0, len(raw), PART))
    adjacent = sum(map(str.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)), float(np.log1p(chars)), len(count) / n**0.9, adjacent / n, max(count.values()) / n, max(of_line.values()) / len(lines), 1 - len(of_line) / len(lines),
        sum(map(len, words)) / n, sum(len(w) > 12 for w in words) / n, len(CHARS["symbols"].findall(text)) / n, text.count("|") / n, len(CHARS["punctuation"].findall(text)) / n,
        len(CHARS["digits"].findall(text)) / chars, len(CAPITAL.findall(text)) / chars, len(LETTERS.findall(text)) / chars, float(np.log1p(n / len(lines))), squeezed / len(raw),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, x) of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], ["doc_id", "x"])

    return text_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, "doc_id long, x array<double>")


class FourierRidge:
    """Standardisation, random features and ridge weights; fit by sums over partitions."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n_features: int, width: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.turns = rng.normal(0, 1 / width, (len(mean), n_features))
        self.phases = rng.uniform(0, 2 * np.pi, n_features)
        self.weights = np.zeros(n_features + 1)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.turns + self.phases) * np.sqrt(2 / len(self.phases))
        return np.c_[np.ones(len(x)), waves]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


def fit(rows: DataFrame, n_features: int = N_FEATURES, width: float = WIDTH, penalty: float = PENALTY, seed: int = SEED) -> FourierRidge:
    """Fit rows (x, y). Without rows all weights are 0."""
    facts = rows.agg(*[f(F.col("x")[i]).alias(f"{name}{i}") for i in range(len(STATISTICS)) for name, f in (("m", F.avg), ("s", F.stddev_pop))], F.count(F.lit(1)).alias("n")).first()
    mean = np.array([facts[f"m{i}"] or 0.0 for i in range(len(STATISTICS))])
    scale = np.array([facts[f"s{i}"] or 0.0 for i in range(len(STATISTICS))])
    model = FourierRidge(mean, np.where(scale > 1e-9, scale, 1.0), n_features, width, seed)
    if not facts["n"]:
        return model
    size = n_features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                z, y = model.features(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                left += z.T @ z
                right += z.T @ y
        full = np.c_[left, right]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(size), size + 1), pa.int32()), pa.array(np.tile(np.arange(size + 1), size), pa.int32()), pa.array(full.ravel())], ["i", "j", "v"])

    parts = rows.select("x", "y").mapInArrow(sums, "i int, j int, v double")
    total = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    full = np.zeros((size, size + 1))
    full[total.column("i").to_numpy(), total.column("j").to_numpy()] = total.column("v").to_numpy()
    ridge = penalty * facts["n"] * np.eye(size) / size
    ridge[0, 0] = 0
    model.weights = np.linalg.solve(full[:, :size] + ridge + 1e-9 * np.eye(size), full[:, size])
    return model


def predict(rows: DataFrame, model: FourierRidge, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, raw, keep) of rows (doc_id, x, keep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(model.predict(_matrix(part.column(1))), 6)), *part.columns[2:]], ["doc_id", "raw", *keep])

    schema = ", ".join(["doc_id long", "raw double", *(f"{n} {t}" for n, t in rows.select(*keep).dtypes)])
    return rows.select("doc_id", "x", *keep).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """Rows (doc_id, held_out, score) of docs (doc_id, text); labels has doc_id and quality, 0 or 1.

    Rows whose crc32(doc_id as text) modulo folds is held_fold teach nothing, nor do
    labels that are null or neither 0 nor 1, nor rows without id, which aren't held out.
    The ridge is fitted on the other folds but one, and the calibration on that one. Null and empty texts have statistics of
    zeros and are scored like others. Repeated rows each give a row. Without labels
    every score is one half; an empty table gives an empty result. Only the text is
    an input of a score.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    rows = materialize(document_statistics(docs), "quality-statistics")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & (fold != held_fold))
    taught = materialize(rows.join(marked.dropDuplicates(["doc_id"]), "doc_id").withColumn("fold", fold), "quality-taught")
    kept_back = (held_fold + 1) % folds
    model = fit(taught.where(F.col("fold") != kept_back))
    told = predict(taught.where(F.col("fold") == kept_back), model, ("y",))
    knots = isotonic.fit(isotonic.binned(told, "raw", "y", -0.5, 1.5, 500))
    discard(taught)
    score = F.round(isotonic.apply(F.col("raw"), knots), 6)
    return predict(rows, model).select("doc_id", F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), score.alias("score"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of whole documents."""
    scores = quality_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return scores.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
