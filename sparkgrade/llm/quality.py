"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum takes
linear time, as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). Inputs are the
words of a text hashed into buckets, statistics of its structure and its length, each in
steps. The machine is fitted on the driver to a bounded sample of labelled rows, of which
only hashed features travel; every text is scored whole where it lies.

Defined cases: a NULL text is scored as the empty text; without labels of both kinds every
score is the neutral 0.5; labels without an id or quality, or with ids that disagree, are not learned
from; every row gives one row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrade.llm.common import BoundedCache, drop_models, hash_sample, only, remainder
from sparkgrade.llm.line_frequency import BLANKS, repeated_words

BUCKETS = 1 << 15
STEPS = 12
STRUCTURE = (
    "length", "words", "upper", "symbols", "bars", "bangs", "stops", "digits", "other_letters", "word_length",
    "types", "top_word", "repeats", "line_length", "same_lines", "short_words",
)
FEATURES = BUCKETS + STEPS * len(STRUCTURE)
WORD = re.compile(r"\w+")
THRESHOLD = 0.3
CACHED_WORDS = 300_000
BATCH = 32


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def structure(text: str, words: list[str], counts: Counter, chars: int) -> list[float]:
    """Each statistic scaled to 0..1, in the order of ``STRUCTURE``."""
    n, tokens = max(1, len(text)), text.split()
    m = max(1, len(tokens))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(re.findall("[A-Za-z]", text))
    upper = len(text) - len(re.sub("[A-ZÀ-ÖØ-Þ]", "", text))
    return [
        min(1.0, np.log1p(max(0, chars)) / 14), min(1.0, np.log1p(len(tokens)) / 12), upper / max(1, letters),
        min(1.0, sum(map(text.count, "#*$%&<>")) / m / 3), min(1.0, text.count("|") / m), min(1.0, text.count("!") / m / 2),
        min(1.0, (text.count(".") + text.count(",")) / m), sum(map(text.count, "0123456789")) / n,
        1 - letters / n, min(1.0, n / m / 20), len(counts) / max(1, len(words)),
        max(counts.values(), default=0) / max(1, len(words)), repeated_words(tokens) / m,
        min(1.0, np.log1p(n / max(1, len(lines))) / 10), 1 - len(set(lines)) / max(1, len(lines)),
        sum(n for w, n in counts.items() if len(w) < 4) / max(1, len(words)),
    ]


def features(text: str, chars: int | None, buckets: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values: words damped and scaled to length one, structure as steps."""
    words = WORD.findall(text.lower())
    counts = Counter(words)
    steps = structure(text, words, counts, len(text) if chars is None else chars)
    at = np.fromiter(map(buckets.__getitem__, counts), np.int64, len(counts))
    value = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
    value /= max(1e-9, np.sqrt((value * value).sum()))
    own = [BUCKETS + i * STEPS + min(STEPS - 1, int(STEPS * np.sqrt(max(0.0, s)))) for i, s in enumerate(steps)]
    return np.concatenate([at, np.array(own, np.int64)]), np.concatenate([value, np.full(len(own), 0.5)])


@dataclass
class FactorMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, value: np.ndarray) -> float:
        spread = self.factors[at] * value[:, None]
        sums = spread.sum(0)
        return self.bias + float(self.weights[at] @ value) + 0.5 * float((sums * sums).sum() - (spread * spread).sum())

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(at, value), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], rank: int = 6, steps: int = 800, rate: float = 0.1, decay: float = 1e-5) -> FactorMachine:
    """Adaptive gradient descent on the logistic loss, in about ``steps`` batches of a fixed
    order, but 4 passes at least; the rarer label weighs as much as the other."""
    random = np.random.default_rng(7)
    good = sum(r[2] for r in rows)
    if not rows or good in (0, len(rows)):
        return FactorMachine(0.0, np.zeros(FEATURES), np.zeros((FEATURES, rank)))
    machine = FactorMachine(0.0, np.zeros(FEATURES), random.normal(0, 0.02, (FEATURES, rank)))
    weigh = {1: len(rows) / 2 / good, 0: len(rows) / 2 / (len(rows) - good)}
    w_sum, v_sum, b_sum = np.full(FEATURES, 1e-6), np.full((FEATURES, rank), 1e-6), 1e-6
    for _ in range(max(4, -(-steps * BATCH // len(rows)))):
        order = random.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            part = [rows[i] for i in order[start:start + BATCH]]
            sizes = np.array([len(r[0]) for r in part])
            at, value = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            spread = machine.factors[at] * value[:, None]
            sums = np.add.reduceat(spread, first)
            raw = machine.bias + np.add.reduceat(machine.weights[at] * value, first)
            raw += 0.5 * ((sums * sums).sum(1) - np.add.reduceat((spread * spread).sum(1), first))
            label = np.array([r[2] for r in part])
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label) * np.where(label == 1, weigh[1], weigh[0]) / len(part)
            each = np.repeat(error, sizes) * value
            used, place = np.unique(at, return_inverse=True)
            w_step = np.bincount(place, each, len(used)) + decay * machine.weights[used]
            v_each = each[:, None] * (np.repeat(sums, sizes, axis=0) - spread)
            v_step = np.stack([np.bincount(place, v_each[:, f], len(used)) for f in range(rank)], 1) + decay * machine.factors[used]
            w_sum[used] += w_step ** 2
            v_sum[used] += v_step ** 2
            b_sum += error.sum() ** 2
            machine.weights[used] -= rate * w_step / np.sqrt(w_sum[used])
            machine.factors[used] -= 0.3 * rate * v_step / np.sqrt(v_sum[used])
            machine.bias -= rate * error.sum() / np.sqrt(b_sum)
    return machine


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 6_000) -> FactorMachine:
    """Fit to about ``most_rows`` labelled rows by id hash, none with remainder 0 by 5."""
    marks = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").where(remainder("doc_id", 5) != 0)
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    chosen = hash_sample(marks.select("doc_id", "quality"), "doc_id", most_rows)
    given = with_length(docs).join(F.broadcast(chosen), "doc_id")  # bounded by most_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_models()
        buckets = BoundedCache(bucket, CACHED_WORDS)
        for batch in batches:
            found = [features(t.as_py() or "", c.as_py(), buckets) for t, c in zip(batch["text"], batch["n_chars"])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], pa.array([f[0].astype("<u2").tobytes() for f in found], pa.binary()),
                    pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary()), batch["quality"].cast(pa.int32()),
                ],
                ["doc_id", "at", "value", "quality"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = given.mapInArrow(run, f"doc_id {kind}, at binary, value binary, quality int").collect()
    return fit([
        (np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(np.float64), r["quality"])
        for r in sorted(rows, key=lambda r: (r["doc_id"], r["at"], r["value"]))
    ])


def with_length(docs: DataFrame) -> DataFrame:
    """doc_id, text and n_chars (the table's metadata, or NULL where it has none)."""
    return docs.select(docs["doc_id"], docs["text"], length_of(docs).alias("n_chars"))


def length_of(docs: DataFrame) -> Column:
    return docs["n_chars"].cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def scorer(docs: DataFrame, machine: FactorMachine) -> Column:
    """The score of every row of ``docs`` (text, n_chars) as a column."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights, machine.factors))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        drop_models()
        own, buckets = FactorMachine(*shared.value), BoundedCache(bucket, CACHED_WORDS)
        for texts, chars in batches:
            yield pd.Series([own.score(*features(t or "", None if pd.isna(c) else int(c), buckets)) for t, c in zip(texts, chars)], dtype="float64")

    return F.pandas_udf("double")(run)(docs["text"], length_of(docs))


def score(docs: DataFrame, machine: FactorMachine) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted (1 from the threshold on)."""
    found = docs.select(docs["doc_id"], scorer(docs, machine).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a machine learned from ``labels`` does not reject."""
    return docs.where(scorer(docs, train(docs, labels)) >= THRESHOLD)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn and score: doc_id, held_out, score, predicted."""
    found = score(docs, train(docs, labels))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")
