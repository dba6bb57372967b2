"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are folded to lower-case letters and blanks; their 1-, 2- and 3-grams are hashed into 2**15 places.
Document frequencies are counted over all rows that may be learned from. The weights are fitted on a
bounded sample by follow-the-regularised-leader (per-coordinate FTRL-proximal) with an elastic-net
penalty, which leaves most of them zero, and a temperature fitted on a part of the sample that the weights
have not seen calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import released
from tidemill.llm.text_features import code_points, folded_letters

PLACES = 1 << 15
UNDETERMINED = "und"
#: About so many texts of each language at most are used to fit the weights.
SAMPLE_PER_LANGUAGE = 500
#: More learned languages than this are refused: the model is held whole by driver and executors.
MAX_LANGUAGES = 200


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams of the whole text, and how often each occurs. Empty if there is no letter."""
    empty = np.zeros(0, np.int32), np.zeros(0, np.int64)
    if not text:
        return empty
    c = folded_letters()[code_points(text)]
    letter = c != 32
    if not letter.any():
        return empty
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    c = np.concatenate(([np.uint32(32)], c[keep], [np.uint32(32)])).astype(np.uint32)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
    three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
    at = np.concatenate((one, two, three)) >> np.uint32(17)
    counts = np.bincount(at, minlength=PLACES)
    places = np.flatnonzero(counts)
    return places.astype(np.int32), counts[places]


def _weighted(places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[places]
    return x / np.sqrt((x * x).sum())


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # places x languages
    temperature: float = 1.0

    def logits(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _weighted(places, counts, self.idf) @ self.weights[places]

    def predict(self, text: str | None) -> tuple[str, float]:
        places, counts = gram_counts(text)
        if not len(places) or not self.languages:
            return UNDETERMINED, 0.0
        p = _softmax(self.logits(places, counts) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(
    rows: list[tuple[int, np.ndarray, np.ndarray]],
    classes: int,
    idf: np.ndarray,
    epochs: int = 4,
    alpha: float = 0.6,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.05,
    seed: int = 7,
) -> np.ndarray:
    """Weights (places x classes) for rows of (class, places, counts)."""
    z, n = np.zeros((PLACES, classes)), np.zeros((PLACES, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    order = np.random.default_rng(seed)
    prepared = [(y, at, _weighted(at, k, idf)) for y, at, k in rows]
    for _ in range(epochs):
        for r in order.permutation(len(prepared)):
            y, at, x = prepared[r]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            squares = g * g
            sigma = (np.sqrt(ns + squares) - np.sqrt(ns)) / alpha
            z[at] = zs + g - sigma * w
            n[at] = ns + squares
    return weights(z, n)


def fit_temperature(logits: list[np.ndarray], labels: list[int]) -> float:
    """The temperature with the least negative log-likelihood, by golden section on its logarithm."""
    if not logits:
        return 1.0
    z, y = np.array(logits), np.array(labels)

    def loss(log_t: float) -> float:
        s = z / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    low, high, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
) -> LanguageModel:
    """A model learned from labelled rows; rows with a null language or id, or without a letter, teach nothing.

    Document frequencies cover all of them; the weights see a sample by hash of the id of about
    sample_per_language texts a language. Without any row the model knows no language and answers und.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang is not null and text is not null and id is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    languages = sorted(sizes)

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, total = np.zeros(PLACES, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                places, _ = gram_counts(text)
                df[places] += 1
                total += bool(len(places))
        at = np.flatnonzero(df)
        yield pd.DataFrame({"place": np.append(at, -1).astype("int32"), "n": np.append(df[at], total)})

    # one row for each place and task, summed before and after the shuffle: 2**15 rows reach the driver
    counted = rows.select("text").mapInPandas(released(frequencies), "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    df, total = np.zeros(PLACES), 0
    for r in counted.collect():
        if r["place"] >= 0:
            df[r["place"]] = r["n"]
        else:
            total = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 1
    if not languages or not total:
        return LanguageModel([], idf, np.zeros((PLACES, 0)))

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(i, lang, *gram_counts(text)) for i, text, lang in zip(batch["id"], batch["text"], batch["lang"])]
            made = [(i, lang, p.tolist(), k.tolist()) for i, lang, p, k in made if len(p)]
            yield pd.DataFrame(made, columns=["id", "lang", "places", "counts"])

    draw = F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rate = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_per_language / n))).otherwise(rate)
    drawn = rows.where(draw < rate).mapInPandas(released(sampled), "id long, lang string, places array<int>, counts array<int>")
    taken = sorted(drawn.orderBy(F.xxhash64("id", "lang", "places")).limit(2 * sample_per_language * len(languages)).collect(), key=lambda r: (r["id"], r["lang"]))
    number = {x: i for i, x in enumerate(languages)}
    made = [(number[r["lang"]], np.array(r["places"], np.int32), np.array(r["counts"])) for r in taken]
    held = [r for i, r in enumerate(made) if i % 5 == 4]
    model = LanguageModel(languages, idf, fit_ftrl([r for i, r in enumerate(made) if i % 5 != 4], len(languages), idf))
    model.temperature = fit_temperature([model.logits(p, k) for _, p, k in held], [y for y, _, _ in held])
    model.weights = model.weights.astype(np.float32)
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the predicted language of each whole text and its probability.

    Null texts and texts without a letter get und and 0. Each row is judged by its text alone, so
    repeated rows get equal answers. Columns of docs with the names of the two new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([shared.value.predict(t) for t in batch], columns=["lang", "score"])

    judged = F.pandas_udf(released(judge), "lang string, score double")
    rest = [c for c in docs.columns if c not in (pred_col, score_col)]
    out = docs.select(*rest, judged(F.col(text_col)).alias("__judged"))
    return out.select(*rest, F.col("__judged.lang").alias(pred_col), F.col("__judged.score").alias(score_col))


def rejected(pred: Column, score: Column, least: float = 0.35) -> Column:
    """What a corpus does without: texts of no language, or of hardly any."""
    return (pred == UNDETERMINED) | (score < least)
