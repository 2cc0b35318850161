"""Language-model scores of documents.

The model is a causal self-attention network over subwords (``attention``), trained in numpy on all
training documents: their frequencies, how often each subword follows each, and every one of their
windows. A short run on some documents gives the weights to begin with. Then all documents are
read in rounds; in a round every task learns from its documents, starting from the same weights, and
the tasks' weights are averaged, each by the subwords it has told. A text is scored
in overlapping windows; what a window shares with the one before is context only, so each
subword is scored once.

Beside it stands a plain score: frequencies of words over all training documents. Words are
counted on Spark. Words that make up at least one part in 1 048 576 of the corpus are at most as
many, and are broadcast; the others are looked up by a join, in which, by the same bound, no
word is hot.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkloom.llm.attention import KNOWN, OVERLAP, WINDOW, Attention
from perkloom.llm.bpe import RANKS, ranks, vocabulary_path
from perkloom.llm.common import crc_fold, documents, stored, whole_text

FOLDS, HELD_OUT = 5, 1
FREQUENT = 1_048_576
SUBWORDS, END = 50_257, 50_256
SAMPLE = 4_000  # training documents that the first weights come from, about
SAMPLE_SUBWORDS = 8_192  # read of each of those, from a place chosen by hash
STEPS = 4_000  # of 64 windows, for the first weights
ROUNDS = 4  # parts of the training documents; weights are averaged after each
RATE = 0.01  # of the first round, falling from round to round
FAN_IN = 16  # sets of weights averaged by one task
WINDOWS_AT_ONCE = 1_024
AT_ONCE = 256  # documents
WORDS_AT_ONCE = 100_000  # different ones, counted before they are passed on


def words(text: str) -> list[bytes]:
    """Lower-cased A-Z, split at ASCII white space."""
    return text.encode().lower().split()


def subwords(found: list[bytes], path: str) -> list[int]:
    """Ids of the words, one blank before each, and the end."""
    ids = ranks(path).encode_ordinary((b" " + b" ".join(found)).decode()) if found else []
    ids.append(END)
    return ids


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of column ``text``; each batch is counted before anything is shuffled."""

    def rows(counts: Counter) -> pa.RecordBatch:
        found = pa.array(counts.keys(), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([found, pa.array(counts.values(), pa.int64())], ["word", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words(text.as_py()))
                if len(counts) > WORDS_AT_ONCE:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    counted = texts.select("text").mapInArrow(count, "word string, c bigint")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def subword_counts(counts: DataFrame, path: str) -> np.ndarray:
    """How often each subword stands in the counted words; every different word is split once."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SUBWORDS)
        for pdf in batches:
            ids = [ranks(path).encode_ordinary(f" {w}") for w in pdf["word"]]
            times = np.repeat(pdf["c"].to_numpy(float), [len(i) for i in ids])
            if len(times):
                total += np.bincount(np.concatenate(ids).astype(np.int64), times, SUBWORDS)
        there = np.flatnonzero(total)
        yield pd.DataFrame({"id": there, "n": total[there]})

    found = counts.mapInPandas(split, "id int, n double").groupBy("id").agg(F.sum("n").alias("n"))
    total, rows = np.zeros(SUBWORDS), found.toPandas()  # at most a row per subword
    total[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return total


def training_sequence(texts: DataFrame, share: float, path: str) -> np.ndarray:
    """Subwords of about ``share`` of the texts, by a hash of their ids, one after another."""

    @F.pandas_udf("array<int>")
    def read(column: pd.Series, place: pd.Series) -> pd.Series:
        found = []
        for text, h in zip(column, place, strict=True):
            ids = subwords(words(text), path)
            start = h % max(1, len(ids) - SAMPLE_SUBWORDS + 1)
            found.append(np.array(ids[start : start + SAMPLE_SUBWORDS], np.int32))
        return pd.Series(found)

    uniform = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 11)
    rows = texts.where(uniform / F.lit(float(2**53)) < share).select("doc_id", read("text", uniform).alias("ids"))
    rows = rows.toPandas().sort_values("doc_id")["ids"]
    return np.concatenate([[END], *rows]).astype(np.int64)


def numbers(counts: np.ndarray) -> np.ndarray:
    """Number of each subword to the network: the most frequent have one each, others share the last."""
    number = np.full(SUBWORDS, KNOWN)
    number[np.argsort(-counts, kind="stable")[:KNOWN]] = np.arange(KNOWN)
    return number


def _sequences(batches: Iterator[pa.RecordBatch], number: np.ndarray) -> Iterator[np.ndarray]:
    """Numbered subwords of column 0, of some documents at a time, one after another."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            ids = b"".join(batch.column(0).slice(at, AT_ONCE).to_pylist())
            yield number[np.frombuffer(ids, np.uint16)]


def follower_counts(ids: DataFrame, number: np.ndarray) -> np.ndarray:
    """How often each numbered subword follows each in all of column ``ids``, an end before every text."""
    size = KNOWN + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for tokens in _sequences(batches, number):
            after = np.concatenate([[number[END]], tokens])  # texts end with one, so the next follows it
            total += np.bincount(after[:-1] * size + after[1:], minlength=size * size)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["pair", "n"])

    found = ids.select("ids").mapInArrow(count, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    total, rows = np.zeros(size * size), found.toPandas()  # at most a row per pair of numbers
    total[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return total


def _averaged(weights: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(told, weights) of many as one row: the mean by what was told."""
    total, told = 0.0, 0
    for batch in weights:
        for n, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total = total + n * np.frombuffer(row, np.float32).astype(float)
            told += n
    if told:
        mean = (total / told).astype(np.float32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([told]), pa.array([mean])], ["told", "weights"])


def learn(scorer: Scorer, ids: DataFrame, rounds: int = ROUNDS) -> int:
    """Train the network on every subword of column ``ids``, once. Gives how many were told.

    A round reads the rows whose ``part`` is its number. Weights are averaged by tasks, ``FAN_IN`` at a
    time, so the driver gets a few sets of them, whatever the number of tasks."""
    sc = ids.sparkSession.sparkContext
    network, number, told = scorer.network, scorer.number, 0
    for r in range(rounds):
        rate, start = RATE * (1 - r / rounds), sc.broadcast(network)

        def train(batches: Iterator[pa.RecordBatch], rate=rate, start=start) -> Iterator[pa.RecordBatch]:
            own = copy.deepcopy(start.value)
            n = own.learn(_sequences(batches, number), number[END], rate)
            flat = np.concatenate([w.ravel() for w in own.p.values()])
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([flat.tobytes()])], ["told", "weights"])

        schema = "told bigint, weights binary"
        rows = ids.where(F.col("part") == r).select("ids")
        found, tasks = rows.mapInArrow(train, schema), rows.rdd.getNumPartitions()
        while tasks > FAN_IN:
            tasks = -(-tasks // FAN_IN)
            found = found.repartition(tasks).mapInArrow(_averaged, schema)
        found = pa.RecordBatch.from_pylist(
            [w.asDict() for w in found.collect()], pa.schema([("told", pa.int64()), ("weights", pa.binary())])
        )
        for mean in _averaged([found]):
            told += mean.column(0)[0].as_py()
            network.set_weights(np.frombuffer(mean.column(1)[0].as_py(), np.float32))
        start.unpersist()
    return told


class Scorer:
    """Log-probability of a sequence of subwords. The attention network knows the most frequent
    ones; any other is one of ``rest``, told apart by its frequency."""

    def __init__(
        self, counts: np.ndarray, sequence: np.ndarray, steps: int = STEPS, pairs: np.ndarray | None = None
    ):
        """``pairs``: how often each numbered subword follows each; of the sequence, if not given."""
        self.number = numbers(counts)
        rest = np.where(self.number == KNOWN, counts + 0.5, 0)
        self.rest = np.where(rest > 0, np.log(np.maximum(rest, 0.5) / rest.sum()), 0)
        tokens = self.number[sequence]
        size = KNOWN + 1
        if pairs is None:
            pairs = np.bincount(tokens[:-1] * size + tokens[1:], minlength=size * size)
        known = np.bincount(self.number, counts, size)
        self.network = Attention(known, pairs.reshape(size, size).astype(float))
        self.network.train(tokens, steps)

    def scores(self, documents: Iterator[list[int] | np.ndarray]) -> list[float]:
        """Natural log-probability of each document, its windows batched with those of others."""
        found: list[float] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []

        def flush():
            if not held:
                return
            x, y, keep = (np.concatenate([h[i] for h in held]) for i in range(3))
            logs = self.network.scores(x, y, keep)
            owner = np.repeat([h[3] for h in held], [h[2].sum() for h in held])
            for d, s in zip(*_sums(owner, logs), strict=True):
                found[d] += s
            held.clear()

        windows = 0
        for d, ids in enumerate(documents):
            ids = np.array(ids, np.int64)
            tokens = self.number[ids]
            found.append(float(self.rest[ids].sum()))
            for x, y, keep in _windows(tokens, self.number[END]):
                held.append((x, y, keep, d))
                windows += len(x)
                if windows >= WINDOWS_AT_ONCE:
                    flush()
                    windows = 0
        flush()
        return found


def _sums(owner: np.ndarray, logs: np.ndarray):
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    return owner[first], np.add.reduceat(logs.astype(float), first)


def _windows(tokens: np.ndarray, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of a document: subwords read (one more before), subwords to tell, and which count."""
    n, step = len(tokens), WINDOW - OVERLAP
    # Two ends before the text: what is told first follows the end of another.
    padded = np.concatenate([[end, end], tokens, np.full(WINDOW, end)])
    starts = np.arange(0, max(1, n - OVERLAP), step)
    for at in range(0, len(starts), WINDOWS_AT_ONCE):
        first = starts[at : at + WINDOWS_AT_ONCE, None]
        inside = np.arange(WINDOW)
        keep = (first + inside < n) & ((inside >= OVERLAP) | (first == 0))
        index = first + np.arange(WINDOW + 1)
        yield padded[index], padded[index[:, 1:] + 1], keep


def _read(texts, path, frequent, end, n_docs) -> list[pa.Array]:
    """Counts, plain score of the frequent words and the end, the other words, and the subwords."""
    tokens, known, base, rare, times, edges, ids = [], [], [], [], [], [0], []
    for text in texts:
        found = words(text)
        logs = np.fromiter(map(frequent.get, found, repeat(np.nan)), float, len(found))
        others = np.isnan(logs)
        count = Counter([found[i] for i in np.flatnonzero(others)])
        rare.extend(count.keys())
        times.extend(count.values())
        edges.append(len(rare))
        tokens.append(len(found) + 1)
        known.append(len(found) - int(others.sum()) + int(n_docs > 0))
        base.append(float(logs[~others].sum()) + end)
        ids.append(np.array(subwords(found, path), np.uint16).tobytes())
    others = pa.StructArray.from_arrays(
        [pa.array(rare, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["word", "n"]
    )
    return [
        pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), others), pa.array(ids, pa.binary()),
    ]


def lm_scores(docs: DataFrame, path: str | None = None, sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """Scores of all documents: ``doc_id``, ``held_out``, ``n_tokens`` (words and one end), ``n_known``
    (seen in training), ``train_tokens``, ``base_score`` (log10, word frequencies with 0.5 added)
    and ``score`` (log10 probability by the model, of the words with single blanks and the end).

    Learns from all documents outside the held-out fold; rows with null id are in fold 0. ``sample`` and
    ``steps`` bound the run that the first weights come from. How documents fall to tasks decides what is
    averaged, so scores may differ slightly between clusters. Null texts are empty: one token, the end.
    Without training documents the model is untrained and every word unknown. One row per input row;
    extra columns are ignored; an empty table gives an empty result."""
    path = path or vocabulary_path(RANKS)
    sc = docs.sparkSession.sparkContext
    texts = docs.select(
        "doc_id", (crc_fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), whole_text().alias("text")
    )
    train = texts.where("not held_out")
    counts = stored(word_counts(train), "word-counts")
    n_docs = docs.select("doc_id").where(crc_fold("doc_id", FOLDS) != HELD_OUT).count()
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n, v = (total[0] or 0) + n_docs, total[1] + (n_docs > 0)
    log_all = float(np.log10(n + 0.5 * (v + 1)))
    frequent = sc.broadcast({
        r["word"].encode(): float(np.log10(r["c"] + 0.5)) - log_all
        for r in counts.where(F.col("c") * FREQUENT >= n).collect()
    })
    end = float(np.log10(n_docs + 0.5)) - log_all
    by_subword = subword_counts(counts, path)
    by_subword[END] += n_docs
    sequence = training_sequence(train, min(1.0, sample / max(1, n_docs)), path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):  # lists of words are large
                part = batch.slice(at, AT_ONCE)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], *_read(part.column(2).to_pylist(), path, frequent.value, end, n_docs)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "rare", "ids"],
                )

    name_type = docs.schema["doc_id"].dataType.simpleString()
    found = stored(
        texts.mapInArrow(
            read,
            f"doc_id {name_type}, held_out boolean, n_tokens bigint, n_known bigint, base double, "
            "rare array<struct<word:string,n:bigint>>, ids binary",
        ).withColumns({
            "row": F.monotonically_increasing_id(),
            "part": F.pmod(F.xxhash64(F.lit("round"), "doc_id", "n_tokens"), F.lit(ROUNDS)),
        }), "read",
    )
    training = found.where("not held_out").select("ids", "part")
    scorer = Scorer(by_subword, sequence, steps, follower_counts(training, numbers(by_subword)))
    learn(scorer, training)
    scorer = sc.broadcast(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = (np.frombuffer(i.as_py(), np.uint16) for i in batch.column(1))
            logs = np.array(scorer.value.scores(ids)) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logs, pa.float64())], ["row", "score"])

    scores = stored(found.select("row", "ids").mapInArrow(score, "row bigint, score double"), "scored")
    looked_up = (
        found.select("row", F.inline("rare")).join(counts, "word", "left")
        .withColumn("c", F.coalesce("c", F.lit(0)))
        .groupBy("row").agg(
            F.sum(F.col("n") * (F.log10(F.col("c") + 0.5) - log_all)).alias("rare_base"),
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        )
    )
    return found.drop("rare", "ids").join(scores, "row").join(looked_up, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score",
    )


def op5_lm_scoring(spark, sf_dir):
    return lm_scores(documents(spark, sf_dir))

