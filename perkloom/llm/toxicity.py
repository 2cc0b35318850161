"""Toxicity by class-conditional Kneser-Ney models.

One word-pair model for toxic and one for ordinary documents. Both discount what they have
counted and give the rest to the same backoff: after how many different words a word stands,
counted over both classes. An expression that is rare or was never seen is so about as likely
in either, and only what one class repeats tells them apart. A document's evidence is the
difference of the two log-likelihoods per word: of the whole text, of its most toxic passage and
of its most telling words; a logistic curve, fitted on training documents that the models have not seen, makes it a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkloom.llm.common import crc_fold, documents, stored, whole_text
from perkloom.llm.labelled import labelled_sample

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
PER_CLASS = 6_000  # labelled documents of each class to fit on, about
COUNTED = 0.7  # share of those for the models; the others fit the curve
DISCOUNT = 3  # documents of a class; what no more have used is left to the backoff
PASSAGE = 40  # words
TELLING = 3  # words
SHORT = 5.0  # words added to every length, so that a word or two decide little
WORDS = re.compile(r"\w+")
CLASSES = ["ordinary", "toxic"]


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def expression_counts(sample: DataFrame) -> DataFrame:
    """(before, word, ordinary, toxic): in how many documents of each class a word (before is
    empty) or a pair of words stands, so that no text counts much by repeating itself."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for y, texts in pdf.groupby("y")["text"]:
                counts = Counter()
                for text in texts:
                    w = words(text)
                    counts.update(zip(repeat(""), set(w)))
                    counts.update(set(zip(w, w[1:], strict=False)))
                yield pd.DataFrame({
                    "before": [a for a, _ in counts], "word": [b for _, b in counts],
                    "y": int(y), "n": list(counts.values()),
                })

    counted = sample.select("text", "y").mapInPandas(count, "before string, word string, y int, n bigint")
    return counted.groupBy("before", "word").agg(*[
        F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(c) for y, c in enumerate(CLASSES)
    ])


class Models:
    """Log-likelihood ratios, toxic over ordinary, of words and of pairs of words.

    p(w) = max(c(w) - D, 0) / N + free p'(w), where ``free`` is the share the discounts leave
    and p'(w) the share of the different pairs that end in w, over both classes;
    p(w | h) = max(c(h, w) - D, 0) / c(h) + free(h) p(w). An expression that neither class has
    more than D times is told by its backoff alone, so the tables hold only the others, which
    the size of the sample bounds."""

    def __init__(self, counts: DataFrame):
        counts = stored(counts, "expressions")
        telling = F.greatest(*CLASSES) > DISCOUNT
        single, pair = counts.where("before = ''"), counts.where("before != ''")
        free = [F.sum(F.least(F.col(c), F.lit(DISCOUNT))) for c in CLASSES]
        totals = single.agg(*[F.sum(c) for c in CLASSES], *free, F.count(F.lit(1))).first()
        size = [max(1, x or 0) for x in totals[:2]]
        rest = [max(1, x or 0) / n for x, n in zip(totals[2:4], size, strict=True)]
        follows = pair.groupBy("word").agg(F.count(F.lit(1)).alias("follows"))
        word = single.where(telling).join(follows, "word", "left").fillna(0).toPandas()
        shared = (word["follows"].to_numpy(float) + 1) / (pair.count() + totals[4] + 1)
        p = [
            np.maximum(word[c].to_numpy(float) - DISCOUNT, 0) / n + r * shared
            for c, n, r in zip(CLASSES, size, rest, strict=True)
        ]
        self.unseen = float(np.log(rest[1] / rest[0]))
        self.word = dict(zip(word["word"], np.log(p[1] / p[0]).tolist(), strict=True))

        after = pair.groupBy("before").agg(
            *[F.sum(c).alias(f"n_{c}") for c in CLASSES],
            *[f.alias(f"free_{c}") for c, f in zip(CLASSES, free, strict=True)],
        )
        both = pair.where(telling).join(after, "before").toPandas()
        both = both.merge(pd.DataFrame({"word": word["word"], "p_ordinary": p[0], "p_toxic": p[1]}), on="word")
        q, left = [], []
        for c in CLASSES:
            n = both[f"n_{c}"].to_numpy(float)
            left.append(np.where(n > 0, both[f"free_{c}"] / np.maximum(n, 1), 1.0))
            seen = np.maximum(both[c].to_numpy(float) - DISCOUNT, 0) / np.maximum(n, 1)
            q.append(seen + left[-1] * both[f"p_{c}"].to_numpy())
        pairs = zip(both["before"], both["word"], strict=True)
        self.pair = dict(zip(pairs, np.log(q[1] / q[0]).tolist(), strict=True))
        self.backoff = dict(zip(both["before"], np.log(left[1] / left[0]).tolist(), strict=True))

    def evidence(self, text: str) -> tuple[float, ...]:
        """Log-likelihood ratio per word of the text, of its most toxic passage and of its most
        telling words; log of the length."""
        w = words(text)
        n = len(w)
        if not n:
            return 0.0, 0.0, 0.0, 0.0
        ratio = np.fromiter(map(self.word.get, w, repeat(self.unseen)), float, n)
        top = np.partition(ratio, max(0, n - TELLING))[-TELLING:].sum() / TELLING
        top -= self.unseen * min(n, TELLING) / TELLING
        pairs = np.fromiter(map(self.pair.get, zip(w, w[1:], strict=False), repeat(np.nan)), float, n - 1)
        backoff = np.fromiter(map(self.backoff.get, w[:-1], repeat(0.0)), float, n - 1)
        ratio[1:] = np.where(np.isnan(pairs), ratio[1:] + backoff, pairs)
        ratio -= self.unseen
        run = np.concatenate([[0.0], np.cumsum(ratio)])
        span = min(n, PASSAGE)
        passage = (run[span:] - run[:-span]).max() / (span + SHORT)
        return run[-1] / (n + SHORT), passage, top, float(np.log1p(n))


SIGNS = ["x0", "x1", "x2", "x3"]


def evidence(texts: DataFrame, models, *also: str) -> DataFrame:
    """(also, x0 .. x3) of column ``text``; ``models`` is broadcast, bounded by the sample."""

    @F.pandas_udf(f"struct<{','.join(f'{x}:double' for x in SIGNS)}>")
    def x(column: pd.Series) -> pd.DataFrame:
        m = models.value
        return pd.DataFrame([m.evidence(t) for t in column], columns=SIGNS, dtype=float)

    return texts.select(*also, x("text").alias("x")).select(*also, "x.*")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression (the last is the intercept) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Scores of all documents: ``doc_id``, ``held_out``, ``score`` and ``predicted``, and the
    columns named in ``carry``.

    Learns from labelled documents outside the held-out fold only, from about ``per_class`` of
    each class at most. Without training labels of both classes every score is the share of toxic
    labels (0 without any). Null and empty texts have the score of no evidence. Rows with null id
    are in fold 0. One row per input row; extra columns are ignored; an empty table gives an
    empty result."""
    spark = docs.sparkSession
    texts = docs.select(
        *carry, "doc_id", whole_text().alias("text"),
        (crc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
    )
    sample, there = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, per_class)
    models = spark.sparkContext.broadcast(Models(expression_counts(sample.where(F.col("u") < COUNTED))))
    fit = evidence(sample.where(F.col("u") >= COUNTED), models, "y").toPandas()
    x, y = fit[SIGNS].to_numpy(), fit["y"].to_numpy()
    if len(set(y)) < 2:
        score = F.lit(there[1] / max(1, there[0] + there[1]))
        scored = texts.withColumn("score", score)
    else:
        mean, scale = x.mean(0), x.std(0) + 1e-9
        # Classes weigh as they do among all training documents, not as in the sample.
        weight = np.array([there[0], there[1]])[y] / np.bincount(y, minlength=2)[y]
        weight *= len(y) / weight.sum()
        *w, intercept = logistic((x - mean) / scale, y, weight)
        logit = F.lit(float(intercept))
        for n, sign in enumerate(SIGNS):
            logit = logit + (F.col(sign) - float(mean[n])) / float(scale[n]) * float(w[n])
        scored = evidence(texts, models, *carry, "doc_id", "held_out").withColumn("score", 1 / (1 + F.exp(-logit)))
    return scored.select(
        *carry, "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op9_toxicity(spark, sf_dir):
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
