"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades 0 to 3 follow P(grade > j) = sigmoid(w x - theta_j): one weight vector for all thresholds, which are ordered by
construction, so the expected severity is the sum of the three probabilities. Features are the words of a text and the
character runs (four and five letters, with marks for a word's ends) in them, by the logarithm of how often they occur; so
inflected and compound forms of a word count, too, and one chance likeness counts less than several.

The tables label texts as toxic or not, without grades. Grade 0 is a text that is not toxic. Toxic texts are graded 1 to 3 by
thirds of how many words they hold with features that toxic texts have far more often than others do.

Training takes at most ``LABELLED`` labelled documents (the smallest hashes of their ids), at most ``FEATURES`` features (the
highest likelihood-ratio scores, at least ``LEAST_SCORE``), and fits on the driver, whose work does not grow with the corpus.
Every document is scored on its whole text.

Defined results: a null or empty text has no features and the severity of such a text, which is not toxic; without labels of
both kinds, or without features, every severity is 0; labels that are null or have no document are left out, of several for one
id the highest counts; repeated rows get the same result; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.text import blobs, letter_words, table
from chronoweave.session import cut_lineage

#: Bound of the labelled sample.
LABELLED = 10_000
#: Bound of the features, and the least likelihood-ratio score (G) of one.
FEATURES, LEAST_SCORE = 4096, 30.0
GRADES = 4
#: From this expected severity on a text is toxic.
TOXIC_FROM = 0.5
#: Words whose features a task keeps.
MEMO = 300_000


def word_features(word: bytes) -> list[str]:
    """The word in brackets, and the runs of four and five letters in it."""
    marked = f"<{word.decode(errors='replace')}>"
    return list({marked, *(marked[i:i + n] for n in (4, 5) for i in range(len(marked) - n + 1))})


def lower_words(blob: bytes) -> list[bytes]:
    return letter_words(blob.decode().lower().encode())


@dataclass
class Model:
    """``index`` numbers the features; weights and thresholds are those of the ordinal regression."""

    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def expected(self, counts: dict[int, int]) -> float:
        if not len(self.thresholds):
            return 0.0
        score = self.weights[list(counts)] @ np.log2(1 + np.array(list(counts.values()), float)) if counts else 0.0
        return float((1 / (1 + np.exp(np.clip(self.thresholds - score, -40, 40)))).sum())


EMPTY = Model({}, np.zeros(0), np.zeros(0))


def fit(rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, n_features: int, steps: int = 500,
        penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of least penalised loss, by full-batch steps of adaptive size."""
    at, column = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, int)]).astype(int)
    value = np.concatenate([*values, np.zeros(0)])
    w, base, gaps = np.zeros(n_features), 1.0, np.zeros(GRADES - 2)  # thresholds: base, then each exp(gap) further
    moment, square = np.zeros(n_features + GRADES - 1), np.zeros(n_features + GRADES - 1)
    for step in range(1, steps + 1):
        thresholds = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        score = np.bincount(at, w[column] * value, len(rows))
        above = np.hstack([np.ones((len(rows), 1)), 1 / (1 + np.exp(np.clip(thresholds - score[:, None], -40, 40))), np.zeros((len(rows), 1))])
        slope = above * (1 - above)
        likely = np.maximum(np.take_along_axis(above[:, :-1] - above[:, 1:], grades[:, None], 1)[:, 0], 1e-12)
        rise = np.zeros((len(rows), GRADES + 1))  # loss by score - threshold, for the two thresholds around the grade
        np.put_along_axis(rise, grades[:, None], (-np.take_along_axis(slope, grades[:, None], 1)[:, 0] / likely)[:, None], 1)
        np.put_along_axis(rise, grades[:, None] + 1, (np.take_along_axis(slope, grades[:, None] + 1, 1)[:, 0] / likely)[:, None], 1)
        by_threshold = -rise[:, 1:-1].sum(0)
        gradient = np.concatenate([
            np.bincount(column, rise.sum(1)[at] * value, n_features) / len(rows) + penalty * w, [by_threshold.sum() / len(rows)],
            np.exp(gaps) * np.cumsum(by_threshold[::-1])[::-1][1:] / len(rows)])
        moment, square = 0.9 * moment + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        w, base, gaps = w - move[:n_features], base - move[n_features], gaps - move[n_features + 1:]
    return w, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def _counted(batches):
    """(text, toxic) to (feature, toxic texts, other texts with it), added up within the task."""
    bad, good = Counter(), Counter()

    def rows():
        names = list(bad | good)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([bad[n] for n in names], pa.int64()), pa.array([good[n] for n in names], pa.int64())],
                                          ["feature", "bad", "good"])

    for batch in batches:
        for blob, toxic in zip(blobs(batch, "_text"), batch.column("_toxic").to_pylist()):
            held: set[str] = set()
            for word in set(lower_words(blob)):
                held.update(word_features(word))
            (bad if toxic else good).update(held)
        if len(bad) + len(good) > 1_000_000:
            yield rows()
            bad.clear()
            good.clear()
    yield rows()


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """The model of at most ``LABELLED`` labelled documents."""
    known = labels.filter(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg((F.max(toxic) > 0).alias("_toxic"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(LABELLED)  # so the side to broadcast is bounded
    sample = cut_lineage(
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").filter("_text IS NOT NULL")
        .groupBy(F.md5("_text").alias("_key")).agg(F.first("_text").alias("_text"), F.max("_toxic").alias("_toxic"))
    )
    sizes = {row["_toxic"]: row["count"] for row in sample.groupBy("_toxic").count().collect()}
    n_bad, n_good = sizes.get(True, 0), sizes.get(False, 0)
    if not n_bad or not n_good:
        return EMPTY
    counts = sample.select("_text", "_toxic").mapInArrow(_counted, "feature string, bad bigint, good bigint").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = n_bad / (n_bad + n_good)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    both = F.col("bad") + F.col("good")
    scored = counts.filter(F.col("bad") > share * both).withColumn("g", 2 * (part(F.col("bad"), share * both) + part(F.col("good"), (1 - share) * both)))
    found = scored.filter(F.col("g") >= LEAST_SCORE).orderBy(F.desc("g"), "feature").limit(FEATURES).collect()
    if not found:
        return EMPTY
    index = {row["feature"]: i for i, row in enumerate(found)}
    strong = {row["feature"] for row in found if row["bad"] > 4 * row["good"]}

    def featured(batches):
        memo: dict[bytes, tuple[list[int], bool]] = {}
        for batch in batches:
            held, counts, strength = [], [], []
            for blob in blobs(batch, "_text"):
                words = lower_words(blob)
                found: Counter = Counter()
                hits = 0
                for word in words:
                    if word not in memo:
                        names = word_features(word)
                        memo[word] = [index[n] for n in names if n in index], any(n in strong for n in names)
                    found.update(memo[word][0])
                    hits += memo[word][1]
                held.append(list(found))
                counts.append(list(found.values()))
                strength.append(hits)
                if len(memo) > MEMO:
                    memo.clear()
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("_toxic"), pa.array(held, kind), pa.array(counts, kind), pa.array(strength, pa.int64())],
                                             ["toxic", "held", "counts", "strength"])

    rows = sample.select("_text", "_toxic").mapInArrow(featured, "toxic boolean, held array<int>, counts array<int>, strength bigint").toArrow()  # LABELLED rows
    bad, strength = np.array(rows["toxic"].to_pylist()), np.array(rows["strength"].to_pylist())
    cuts = np.quantile(strength[bad], [1 / 3, 2 / 3])
    grades = np.where(bad, 1 + (strength[:, None] > cuts).sum(1), 0)
    values = [np.log2(1 + np.array(counts, float)) for counts in rows["counts"].to_pylist()]
    weights, thresholds = fit([np.array(held, int) for held in rows["held"].to_pylist()], values, grades, len(index))
    return Model(index, weights, thresholds)


def score(docs: DataFrame, model: Model, text: str = "text", severity: str = "expected_severity") -> DataFrame:
    """``docs`` with the expected severity of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of at most FEATURES features

    def run(batches):
        held, memo = shared.value, {}
        for batch in batches:
            out = []
            for blob in blobs(batch, text):
                counts: dict[int, int] = {}
                for word, times in Counter(lower_words(blob)).items():
                    found = memo.get(word)
                    if found is None:
                        found = memo[word] = [held.index[n] for n in word_features(word) if n in held.index]
                    for feature in found:
                        counts[feature] = counts.get(feature, 0) + times
                out.append(held.expected(counts))
                if len(memo) > MEMO:
                    memo.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, severity])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, `{severity}` double")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their columns."""
    return score(docs, train(docs, labels), severity="_cw_severity").filter(F.col("_cw_severity") < TOXIC_FROM).drop("_cw_severity")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, the grade nearest to it, and the verdict."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    severity = F.col("expected_severity")
    return scored.select("doc_id", severity, F.round(severity).cast("int").alias("severity"), (severity >= TOXIC_FROM).alias("toxic"))
