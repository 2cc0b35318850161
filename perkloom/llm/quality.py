"""Quality by random-indexing word vectors and a small network.

Every frequent token has a sparse random index vector; its context vector is the sum of the
index vectors of its neighbours over the whole corpus, added up by Spark. A document is the mean
of its tokens' vectors. A two-layer network in numpy scores it, and a temperature, fitted on
training documents the network has not seen, makes the scores probabilities.

Tokens that are not frequent are read by their shape (capitals, small letters, digits, marks), and
a token that repeats the one before it as a repeat, so that every token has a vector.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkloom.llm.common import crc_fold, documents, stored, whole_text
from perkloom.llm.labelled import labelled_sample

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
PER_CLASS = 4_000  # labelled documents of each class to fit on, about
TRAINED = 0.75  # share of those for the network; the others set the temperature
FREQUENT = 4_096  # a frequent token is at least one in so many, so there are no more of them
INDEX = 64  # length of an index vector
MARKS = 4  # places of it that are not zero
HIDDEN = 32
EPOCHS = 60
TOKENS = re.compile(r"\w+|[^\w\s]+")
SHAPE_MAX = 4
REPEAT = "(repeat)"


def tokens(text: str) -> list[str]:
    return TOKENS.findall(text)


def shape(token: str) -> str:
    """Classes of characters, runs as one, the first few: Xx for a capitalised word."""
    if token.isalpha():  # most are plain words
        if token.islower():
            return "(x)"
        if token.istitle() and token[1:]:
            return "(Xx)"
    kinds = []
    for c in token[:64]:
        kind = "9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else "#"
        if not kinds or kinds[-1] != kind:
            kinds.append(kind)
    return f"({''.join(kinds[:SHAPE_MAX])})"


def frequent_tokens(docs: DataFrame, one_in: int = FREQUENT) -> list[str]:
    """Tokens of at least one in ``one_in`` of all tokens of all texts, most frequent first; the
    share bounds their number. Counts are combined in each task before they are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = Counter()
            for text in pdf["text"]:
                counts.update(tokens(text))
            yield pd.DataFrame({"token": list(counts), "n": list(counts.values())})

    counted = docs.select(whole_text().alias("text")).mapInPandas(count, "token string, n bigint")
    totals = stored(counted.groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    least = (totals.agg(F.sum("n")).first()[0] or 0) / one_in
    found = totals.where(F.col("n") >= max(1.0, least)).orderBy(F.col("n").desc(), "token")
    return [r["token"] for r in found.collect()]


class Vocabulary:
    """Numbers of tokens; what is not frequent goes by shape."""

    def __init__(self, frequent: list[str]):
        shapes = _shapes()
        self.number = {t: i for i, t in enumerate([*frequent, *shapes, REPEAT])}
        self.size = len(self.number)

    def numbers(self, text: str) -> np.ndarray:
        found = tokens(text)
        numbers = np.array([self._number(t) for t in found], np.int32)
        repeats = [i for i, (a, b) in enumerate(zip(found, found[1:], strict=False), 1) if a == b]
        numbers[repeats] = self.number[REPEAT]
        return numbers

    def _number(self, token: str) -> int:
        n = self.number.get(token)
        return self.number[shape(token)] if n is None else n

    def index_vectors(self) -> np.ndarray:
        import xxhash

        vectors = np.zeros((self.size, INDEX), np.float32)
        for token, n in self.number.items():
            for mark in range(MARKS):
                h = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), mark)
                vectors[n, h % INDEX] += 1 if h >> 63 else -1
        return vectors


def _shapes() -> list[str]:
    found, grown = [], [""]
    for _ in range(SHAPE_MAX):
        grown = [s + c for s in grown for c in "9Xx#" if not s.endswith(c)]
        found += grown
    return [f"({s})" for s in found]


def context_vectors(docs: DataFrame, vocabulary) -> np.ndarray:
    """Sum of the neighbours' index vectors of each token over all texts.

    Each task adds up a table of its own, whose size the vocabulary fixes, and the tables are
    added by token. ``vocabulary`` is broadcast."""
    columns = [f"v{i}" for i in range(INDEX)]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary.value
        index = v.index_vectors()
        total = np.zeros((v.size, INDEX))
        for pdf in batches:
            for text in pdf["text"]:
                n = v.numbers(text)
                for at in range(0, len(n) - 1, 65_536):  # a very long text in parts
                    part = n[at : at + 65_537]
                    for a, b in ((part[:-1], part[1:]), (part[1:], part[:-1])):
                        order = np.argsort(a, kind="stable")
                        first = np.flatnonzero(np.diff(a[order], prepend=-1))
                        total[a[order[first]]] += np.add.reduceat(index[b[order]], first, axis=0)
        there = np.flatnonzero(np.abs(total).sum(1))
        if len(there):
            yield pd.DataFrame(total[there], columns=columns).assign(token=there)

    schema = ", ".join(f"{c} double" for c in columns) + ", token int"
    summed = docs.select(whole_text().alias("text")).mapInPandas(add, schema).groupBy("token").agg(
        *[F.sum(c).alias(c) for c in columns]
    )
    vectors = np.zeros((vocabulary.value.size, INDEX))
    rows = summed.toPandas()  # a row per token of the vocabulary
    vectors[rows["token"].to_numpy()] = rows[columns].to_numpy()
    return vectors


class Pooling:
    """Documents as the mean of their tokens' index and context vectors."""

    def __init__(self, vocabulary: Vocabulary, context: np.ndarray):
        self.vocabulary = vocabulary
        length = np.linalg.norm(context, axis=1, keepdims=True)
        both = [vocabulary.index_vectors() / np.sqrt(MARKS), context / np.maximum(length, 1e-9)]
        self.vectors = np.hstack(both).astype(np.float32)

    def __call__(self, text: str) -> np.ndarray:
        n = self.vocabulary.numbers(text)
        counts = np.bincount(n, minlength=0)
        there = np.flatnonzero(counts)
        pooled = counts[there] @ self.vectors[there] / max(1, len(n))
        return np.concatenate([pooled, [np.log1p(len(n))]])


class Network:
    """Two layers, trained by Adam on weighted cross-entropy; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 5):
        random = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        self.p = [
            random.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
            random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1),
        ]
        self.temperature = 1.0
        m, v, t = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p], 0
        for _ in range(EPOCHS):
            for rows in np.array_split(random.permutation(len(z)), max(1, len(z) // 128)):
                t += 1
                for i, g in enumerate(self._gradients(z[rows], y[rows], weight[rows])):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    step = m[i] / (1 - 0.9**t) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
                    self.p[i] = self.p[i] - 0.003 * (step + 0.003 * self.p[i])

    def _gradients(self, z, y, weight):
        a, b, c, d = self.p
        h = np.tanh(z @ a + b)
        error = weight * (1 / (1 + np.exp(-np.clip(h @ c + d, -30, 30))) - y) / len(z)
        back = error[:, None] * c * (1 - h * h)
        return z.T @ back, back.sum(0), h.T @ error, error.sum(keepdims=True)

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.p
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The temperature of least weighted cross-entropy."""
        logit = self.logit(x)

        def loss(t):
            z = logit / t * np.where(y == 1, 1, -1)
            return (weight * np.logaddexp(0, -z)).sum()

        self.temperature = min(np.geomspace(0.2, 10, 200), key=loss)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Scores of all documents: ``doc_id``, ``held_out``, ``score`` (of label 1) and ``predicted``.

    Learns from labelled documents outside the held-out fold only, from about ``per_class`` of each
    class at most; token counts and vectors are of all texts. Without training labels of both
    classes every score is the share of label 1 (0 without any). Null texts are empty, and a text
    without tokens is scored by the zero vector. Rows with null id are in fold 0. One row per
    input row; extra columns are ignored; an empty table gives an empty result."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select("doc_id", (crc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), whole_text().alias("text"))
    sample, there = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, per_class)
    vocabulary = sc.broadcast(Vocabulary(frequent_tokens(docs)))
    pooling = sc.broadcast(Pooling(vocabulary.value, context_vectors(docs, vocabulary)))

    @F.pandas_udf("array<double>")
    def pooled(column: pd.Series) -> pd.Series:
        return pd.Series([pooling.value(t) for t in column])

    fit = sample.select("y", "u", pooled("text").alias("x")).toPandas()  # bounded by the sample
    y = fit["y"].to_numpy()
    if len(set(y)) < 2:
        scored = texts.withColumn("score", F.lit(there[1] / max(1, there[0] + there[1])))
    else:
        x = np.array(fit["x"].tolist())
        # Classes weigh as they do among all training documents, not as in the sample.
        weight = np.array([there[0], there[1]])[y] / np.bincount(y, minlength=2)[y]
        weight *= len(y) / weight.sum()
        train = fit["u"].to_numpy() < TRAINED
        network = Network(x[train], y[train], weight[train])
        if not train.all():
            network.calibrate(x[~train], y[~train], weight[~train])
        network = sc.broadcast(network)

        @F.pandas_udf("double")
        def score(column: pd.Series) -> pd.Series:
            if column.empty:
                return pd.Series(dtype=float)
            return pd.Series(network.value.score(np.array([pooling.value(t) for t in column])))

        scored = texts.withColumn("score", score("text"))
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op8_quality(spark, sf_dir):
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
