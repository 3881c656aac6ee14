"""Toxicity by a classifier chain: linear models, one a category in a given order; each later model also takes the
earlier categories' probabilities, which during training are out-of-fold predictions.

Features are the words that a whole text holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, words_of
from tessera.llm.linear import sigmoid, sparse_logistic

#: Most labelled rows that the chain is fitted on; words that each model chooses from; folds.
MOST_ROWS, MOST_WORDS, FOLDS = 12_000, 2_000, 5


@dataclass
class Chain:
    """``words``: a weight for each category; ``links``: for category k, weights of the k earlier ones' log-odds, then the bias."""

    categories: list[str]
    words: dict[bytes, tuple[float, ...]]
    links: list[np.ndarray]
    #: The probability from which a category holds: of best F1 among the out-of-fold predictions.
    least: list[float]

    def predict(self, words: list[bytes]) -> list[float]:
        sums = np.zeros(len(self.categories))
        for w in self.words.keys() & set(words):
            sums += self.words[w]
        odds: list[float] = []
        for k, link in enumerate(self.links):
            odds.append(float(sums[k] + np.dot(link[:-1], odds) + link[-1]))
        return [float(sigmoid(o)) for o in odds]


def _fit_one(docs: list[np.ndarray], n_words: int, y: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Weights over all words (mostly 0), ``extra`` and the bias. Words compete by their chi-square with the category."""
    rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    cols = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    n, pos = len(y), y.sum()
    out = np.zeros(n_words + extra.shape[1] + 1)
    if pos in (0, n):
        out[-1] = 6.0 if pos else -6.0
        return out
    df, dp = np.bincount(cols, minlength=n_words), np.bincount(cols, y[rows], n_words)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (dp * (n - pos - df + dp) - (df - dp) * (pos - dp)) ** 2 / (pos * (n - pos) * df * (n - df))
    chi[~np.isfinite(chi) | (df < 3)] = 0
    chosen = np.sort(np.argsort(-chi, kind="stable")[:MOST_WORDS])
    place = np.full(n_words, -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[cols] >= 0
    w = sparse_logistic(rows[keep], place[cols[keep]], extra, y, len(chosen))
    out[chosen], out[n_words:] = w[: len(chosen)], w[len(chosen) :]
    return out


def _margin(docs: list[np.ndarray], n_words: int, w: np.ndarray, extra: np.ndarray) -> np.ndarray:
    return np.array([w[:n_words][d].sum() for d in docs]) + extra @ w[n_words:-1] + w[-1]


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of best F1, halfway to the next lower probability; one half where there is nothing to tell apart."""
    if not len(y) or y.sum() in (0, len(y)):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    last = np.append(p[order][1:] != p[order][:-1], True)
    f1 = np.where(last, 2 * hits / (np.arange(1, len(y) + 1) + y.sum()), 0)
    i = int(np.argmax(f1))
    return float((p[order[i]] + p[order[i + 1]]) / 2) if i + 1 < len(y) else float(p[order[i]])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, categories: dict[str, Column]) -> Chain:
    """A chain over ``categories``, in order: name to a boolean of ``labels``; null leaves a row out of that category.

    Fitted on at most ``MOST_ROWS`` labelled documents, drawn by a hash of their id; their texts are read whole. Texts
    of the same words are of one fold, so that no copy of a text tells its own out-of-fold odds.
    Labels without a document, and documents with null ids, teach nothing; of repeated ids each row counts.
    """
    spark = docs.sparkSession
    ship(spark)
    names = list(categories)
    known = labels.select(F.col(doc_id).alias("id"), *[c.cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())]).where("id is not null")
    n = known.count()
    cut = int(min(1.0, 0.95 * MOST_ROWS / max(1, n)) * (1 << 30))
    drawn = known.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < cut).limit(MOST_ROWS)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn), "id")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [b" ".join(sorted(set(words_of(raw)))) for raw in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[batch.column(f"y{k}") for k in range(len(names))], pa.array(found, pa.binary())], ["id", *[f"y{k}" for k in range(len(names))], "words"])

    kind = rows.schema["id"].dataType.simpleString()
    shape = ", ".join([f"id {kind}", *[f"y{k} int" for k in range(len(names))], "words binary"])
    sample = rows.mapInArrow(featurise, shape).orderBy(F.xxhash64(F.col("id").cast("string")), "id", "words").limit(MOST_ROWS).collect()
    df: dict[bytes, int] = {}
    for r in sample:
        for w in bytes(r["words"]).split():
            df[w] = df.get(w, 0) + 1
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, k in df.items() if k >= 3))}
    held = [np.array([vocabulary[w] for w in bytes(r["words"]).split() if w in vocabulary], np.int64) for r in sample]
    fold = np.array([zlib.crc32(bytes(r["words"])) % FOLDS for r in sample], np.int64)
    earlier = np.zeros((len(held), 0))
    weights, links, least = [], [], []
    for k in range(len(names)):
        y = np.array([np.nan if r[f"y{k}"] is None else float(r[f"y{k}"]) for r in sample])
        told = np.flatnonzero(~np.isnan(y))
        w = _fit_one([held[i] for i in told], len(vocabulary), y[told], earlier[told])
        weights.append(w[: len(vocabulary)])
        links.append(w[len(vocabulary) :])
        odds = np.zeros(len(held))
        for f in range(FOLDS):
            learn = told[fold[told] != f]
            part = _fit_one([held[i] for i in learn], len(vocabulary), y[learn], earlier[learn])
            out = np.flatnonzero(fold == f)
            odds[out] = _margin([held[i] for i in out], len(vocabulary), part, earlier[out])
        least.append(_best_cut(sigmoid(odds[told]), y[told]))
        earlier = np.concatenate([earlier, odds[:, None]], 1)
    words = {w: tuple(float(x[i]) for x in weights) for w, i in vocabulary.items() if any(x[i] for x in weights)}
    return Chain(names, words, links, least)


def score(docs: DataFrame, row_id: Column, text: Column, chain: Chain) -> DataFrame:
    """One row for each row of ``docs``: ``row_id`` and a probability ``p_<category>`` for each category.

    Whole texts are read; null and empty texts hold no words and get the chain's bare odds. Repeated rows each get
    their row; null ids stay; empty tables give no rows; columns not named aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(chain)
    given = docs.select(row_id.alias("row_id"), text.alias("text"))
    names = [f"p_{c}" for c in chain.categories]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = np.array([model.predict(words_of(raw)) for raw in batch.column(1).cast(pa.binary()).to_pylist()]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, k], pa.float64()) for k in range(len(names))]], ["row_id", *names])

    return given.mapInArrow(scan, ", ".join([f"row_id {given.schema['row_id'].dataType.simpleString()}", *[f"`{c}` double" for c in names]]))
