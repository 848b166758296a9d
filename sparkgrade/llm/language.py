"""Language identification: known words first, then ever shorter character n-grams.

Training counts words per language over a documented sample of the labelled rows, and from
them the n-grams of the words with their edges marked. The tables keep the commonest
entries of each language, so the model's size is bounded by its parameters; it travels with
the tasks. A known word scores each language by its log frequency there. An unseen word
takes the mean log frequency of its known 4-grams, or else 3-grams, 2-grams, letters.

Defined cases: a NULL text or one without a letter is ``und`` with score 0, and so is every
text if nothing was learned; rows without a language or id are not learned from; equal
sums go to the language first by name; every row gives one row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrade.llm.common import hash_sample, only, remainder, whole

UNKNOWN = "und"
CACHED_WORDS = 300_000
SURE_WORDS = 20


@dataclass
class LanguageModel:
    """``words[w]`` and ``grams[g]``: log frequency in each language, in the order of ``names``."""

    names: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    rows: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def backoff(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        edged = f"<{word}>"
        for n in range(4, 0, -1):
            found = [g for i in range(len(edged) - n + 1) if (g := self.grams.get(edged[i:i + n])) is not None]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.names))

    def row(self, word: str) -> int:
        at = self.rows.get(word)
        if at is None:
            at = len(self.rows)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at] = self.backoff(word)
            self.rows[word] = at
        return at

    def predict(self, text: str) -> tuple[str, float]:
        import regex

        words = regex.findall(r"\p{L}+", text.lower())
        if not words or not self.names:
            return UNKNOWN, 0.0
        if self.table is None or len(self.rows) > CACHED_WORDS:
            self.rows, self.table = {}, np.zeros((4096, len(self.names)))
        rows = [self.row(w) for w in words]
        mean = self.table[rows].sum(0) / len(words)
        odds = np.exp((mean - mean.max()) * min(len(words), SURE_WORDS))
        best = int(np.argmax(odds))
        return self.names[best], float(odds[best] / odds.sum())


def commonest(counts: DataFrame, key: str, most: int, *groups: str) -> DataFrame:
    """The ``most`` commonest entries of each group; ties by the entry itself."""
    order = Window.partitionBy(*groups).orderBy(F.desc("n"), key)
    return counts.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most).drop("_at")


def log_table(counts: list, key: str, names: list[str], smooth: float = 0.5) -> dict[str, np.ndarray]:
    """Per entry its smoothed log frequency in each language, among the entries kept."""
    at = {n: i for i, n in enumerate(names)}
    found: dict[str, np.ndarray] = {}
    for row in counts:
        found.setdefault(row[key], np.zeros(len(names)))[at[row["lang"]]] += row["n"]
    totals = sum(found.values(), np.zeros(len(names))) + smooth * max(1, len(found))
    return {k: np.log((v + smooth) / totals) for k, v in found.items()}


def train(docs: DataFrame, most_rows: int = 20_000, most_words: int = 20_000, most_grams: int = 4_000) -> LanguageModel:
    """Learn from rows of ``docs`` (doc_id, text, lang) with a language: about ``most_rows`` of
    them by id hash; keep ``most_words`` words and ``most_grams`` n-grams of each length per language."""
    rows = hash_sample(only(docs, "doc_id", "text", "lang").where("lang IS NOT NULL AND doc_id IS NOT NULL"), "doc_id", most_rows)
    word = F.explode(F.regexp_extract_all(F.lower(whole()), F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    words = rows.select("lang", word).groupBy("lang", "word").agg(F.count("*").alias("n"))
    kept = commonest(words, "word", most_words, "lang").collect()
    edged = F.concat(F.lit("<"), F.col("word"), F.lit(">"))

    def of_length(n: int) -> Column:
        # Every place in one pass: substrings by place would cost the square of a long word.
        return F.regexp_extract_all(edged, F.lit(f"(?=(.{{{n}}}))"), F.lit(1))

    grams = words.select("lang", "n", F.explode(F.flatten(F.array(*[F.coalesce(of_length(n), F.array()) for n in range(1, 5)]))).alias("gram"))
    sums = grams.where(~F.col("gram").isin("<", ">")).groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("size", F.length("gram"))
    kept_grams = commonest(sums, "gram", most_grams, "lang", "size").collect()
    names = sorted({r["lang"] for r in kept})
    tables = [log_table([r for r in kept_grams if r["size"] == n], "gram", names) for n in range(1, 5)]
    return LanguageModel(names, log_table(kept, "word", names), {k: v for t in tables for k, v in t.items()})


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, lang_pred, score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.words, model.grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for batch in batches:
            found = [own.predict(t.as_py() or "") for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    docs = only(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose id's remainder by 3 is not 1, predict all rows."""
    part = remainder("doc_id", 3)
    found = predict(docs, train(docs.where(part != 1)))
    return found.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
