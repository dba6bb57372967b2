"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Counts and ratios of each whole text are brought to roughly normal shape by logarithms and square roots.
Class means and covariances are sums over all labelled rows, gathered by Spark; each covariance is shrunk
towards the pooled one and towards a multiple of the identity. A score is the logistic function of the
difference of Mahalanobis log-densities, through Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import text_features as T

STATISTICS = (
    "log_chars", "log_words", "word_chars", "upper", "digit", "line", "stop", "bang", "bar", "symbol",
    "distinct_words", "repeated_lines", "long_words",
)
SIZE = len(STATISTICS)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; null counts as empty."""
    text = text or ""
    n = len(text)
    k = np.bincount(T.char_classes()[T.code_points(text)], minlength=10).astype(float)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    letters = k[T.LOWER] + k[T.UPPER]
    per = lambda x, of: float(np.sqrt(x / of)) if of else 0.0
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(np.log1p(letters / len(words))) if words else 0.0,
        per(k[T.UPPER], letters), per(k[T.DIGIT], n), per(k[T.LINE], n), per(k[T.STOP], n), per(k[T.BANG], n),
        per(k[T.BAR], n), per(k[T.SYMBOL], n), len(set(words)) / len(words) if words else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0, per(sum(len(w) > 14 for w in words), len(words)),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id and stats (array of double)."""

    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([statistics(t) for t in batch])

    return docs.select(F.col(id_col).alias("id"), F.pandas_udf(measured, "array<double>")(F.col(text_col)).alias("stats"))


@dataclass
class QualityModel:
    """Means, Cholesky factors and log-determinants of the classes 0 and 1; empty if a class has no rows."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    constant: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), self.constant)
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            y = np.linalg.solve(factor, (x - mean).T)
            logs.append(offset - 0.5 * (y * y).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))


def model_from_sums(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.2, ridge: float = 0.02) -> QualityModel:
    """sums: per class its number of rows, sum of x and sum of x x'."""
    total = sum(n for n, _, _ in sums.values())
    if set(sums) != {0, 1}:
        return QualityModel([], [], [], constant=float(next(iter(sums), 0.5)))
    means = {c: s / n for c, (n, s, _) in sums.items()}
    within = {c: q / n - np.outer(means[c], means[c]) for c, (n, _, q) in sums.items()}
    pooled = sum(sums[c][0] * within[c] for c in (0, 1)) / total
    model = QualityModel([], [], [])
    for c in (0, 1):
        s = (1 - shrink) * within[c] + shrink * pooled
        s = (1 - ridge) * s + ridge * np.eye(SIZE) * max(np.trace(s) / SIZE, 1e-6)
        factor = np.linalg.cholesky((s + s.T) / 2)
        model.means.append(means[c])
        model.factors.append(factor)
        model.offsets.append(float(np.log(sums[c][0] / total) - np.log(np.diag(factor)).sum()))
    return model


def fit(labelled: DataFrame) -> QualityModel:
    """labelled: stats and label (0 or 1; others teach nothing). All rows count; a few hundred sums reach the driver."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            if len(batch):
                x = np.vstack(batch["stats"].to_numpy())
                x = np.hstack([np.ones((len(x), 1)), x])
                for c in (0, 1):
                    own = x[batch["label"].to_numpy() == c]
                    if len(own):
                        kept[c] = kept.get(c, 0) + own.T @ own
        for c, q in kept.items():
            i, j = np.triu_indices(SIZE + 1)
            yield pd.DataFrame({"label": c, "i": i, "j": j, "s": q[i, j]})

    rows = labelled.select("stats", F.col("label").cast("int").alias("label")).where("label in (0, 1) and stats is not null")
    found = rows.mapInPandas(summed, "label int, i int, j int, s double").groupBy("label", "i", "j").agg(F.sum("s").alias("s"))
    whole: dict[int, np.ndarray] = {}
    for r in found.collect():
        q = whole.setdefault(r["label"], np.zeros((SIZE + 1, SIZE + 1)))
        q[r["i"], r["j"]] = q[r["j"], r["i"]] = r["s"]
    return model_from_sums({c: (q[0, 0], q[0, 1:], q[1:, 1:]) for c, q in sorted(whole.items())})


def score(measured: DataFrame, model: QualityModel, score_col: str = "score") -> DataFrame:
    """measured (with stats) and the score of each row: from 0 to 1, higher where label 1 is likelier."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def judge(stats: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in stats:
            yield pd.Series(shared.value.scores(np.vstack(batch.to_numpy())) if len(batch) else [], dtype=float)

    return measured.withColumn(score_col, F.pandas_udf(judge, "double")(F.col("stats")))
