"""Operator 2: a quality classifier by ordinal cumulative-link regression.

One weight vector over hashed text is shared by all grades; ordered thresholds
cut its value into grades: P(grade <= k) = sigmoid(threshold_k - value). A
document's value is the mean over its words of the weights of the word, its
ending and its shape, plus those of buckets of whole-text rates. The mean of
the grade and the probability of a grade above a given one follow, and the
latter selects.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows, those with the
least hash of their id. Scores cover every row and its whole text.
"""

from __future__ import annotations

import operator
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 6000
BUCKETS = 1 << 16
#: Weight of word features against whole-text buckets.
WORD_SCALE = 8.0
STEPS, RATE, PENALTY = 150, 0.15, 1e-5
#: A row is kept if the probability of a grade above the lowest is at least this.
KEEP_PROBABILITY = 0.5
MAX_CACHED_WORDS = 150_000

_SHAPES = bytes(b"X"[0] if 65 <= b <= 90 else b"x"[0] if 97 <= b <= 122 or b >= 128 else b"9"[0] if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def _bucket(kind: bytes, value: bytes) -> int:
    return xxhash.xxh32_intdigest(kind + value) % BUCKETS


def word_features(word: bytes) -> tuple[int, int, int]:
    return _bucket(b"w", word), _bucket(b"e", word[-3:]), _bucket(b"s", _RUNS.sub(rb"\1", word.translate(_SHAPES)))


def text_features(words: list[bytes]) -> list[int]:
    """Buckets of rates of the whole text: repeats, distinct words, length."""
    n = len(words)
    if not n:
        return [_bucket(b"t", b"empty")]
    again = sum(map(operator.eq, words, words[1:])) / n
    distinct = len(set(words)) / n
    return [_bucket(b"r", b"%d" % int(again * 20)), _bucket(b"d", b"%d" % int(distinct * 10)), _bucket(b"n", b"%d" % n.bit_length())]


@dataclass
class Ordinal:
    """Weights, ascending thresholds and the grades that they part."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    @classmethod
    def fit(cls, sizes: np.ndarray, column: np.ndarray, value: np.ndarray, grades: np.ndarray) -> Ordinal:
        """Penalised maximum likelihood by Adam over all rows at once.

        Rows follow one another in ``column`` and ``value`` with ``sizes`` entries each.
        """
        levels, y = np.unique(grades, return_inverse=True)
        k = len(levels)
        if k < 2:
            return cls(np.zeros(BUCKETS), np.zeros(0), levels)
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        share = np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y)
        first = np.log(share / (1 - share))
        # thresholds are the first one and logs of the steps between them
        p = np.concatenate([np.zeros(BUCKETS), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, STEPS + 1):
            theta = np.concatenate([p[BUCKETS : BUCKETS + 1], np.exp(p[BUCKETS + 1 :])]).cumsum()
            z = np.bincount(row, value * p[column], len(sizes))
            edge = np.concatenate([[-np.inf], theta, [np.inf]])
            with np.errstate(over="ignore"):
                high, low = 1 / (1 + np.exp(z - edge[y + 1])), 1 / (1 + np.exp(z - edge[y]))
            inside = np.maximum(high - low, 1e-12)
            d_high, d_low = high * (1 - high) / inside, low * (1 - low) / inside
            by_z = (d_high - d_low) / len(sizes)  # of the negative log likelihood
            grad = np.zeros_like(p)
            grad[:BUCKETS] = np.bincount(column, value * by_z[row], BUCKETS) + PENALTY * p[:BUCKETS]
            by_theta = (np.bincount(y, d_low, k)[1:] - np.bincount(y, d_high, k)[:-1]) / len(sizes)
            tail = by_theta[::-1].cumsum()[::-1]
            grad[BUCKETS:] = tail * np.concatenate([[1.0], np.exp(p[BUCKETS + 1 :])])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            p = p - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        theta = np.concatenate([p[BUCKETS : BUCKETS + 1], np.exp(p[BUCKETS + 1 :])]).cumsum()
        return cls(p[:BUCKETS], theta, levels)

    def above(self, value: float) -> np.ndarray:
        """Probabilities of a grade above each but the highest."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - value, -700, 700)))

    def expected(self, value: float) -> float:
        return float(self.grades[0] + (np.diff(self.grades) * self.above(value)).sum())


class _Weights(dict):
    """Sums of a word's weights, kept up to a bound."""

    def __init__(self, weights: np.ndarray) -> None:
        self._weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        w = self._weights
        a, b, c = word_features(word)
        value = self[word] = float(w[a] + w[b] + w[c])
        return value


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns, values = [], []
        for text in batch.column(2):
            words = (text.as_py() or b"").split()
            total: Counter = Counter()
            for word, n in Counter(words).items():
                for f in word_features(word):
                    total[f] += WORD_SCALE * n / len(words)
            total.update(text_features(words))
            columns.append(np.fromiter(total.keys(), np.int32, len(total)))
            values.append(np.fromiter(total.values(), np.float64, len(total)))
        kinds = pa.list_(pa.int32()), pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns, kinds[0]), pa.array(values, kinds[1])], ["id", "grade", "columns", "values"])


def _grade(shared):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = common.kept("quality", key, lambda _: _Weights(model.weights))
        for batch in batches:
            expected, tail = [], []
            for text in batch.column(1):
                words = (text.as_py() or b"").split()
                value = sum(model.weights[f] for f in text_features(words))
                if words:
                    value += WORD_SCALE * sum(map(weights.__getitem__, words)) / len(words)
                expected.append(model.expected(value))
                tail.append(float(model.above(value)[0]) if len(model.thresholds) else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected, pa.float64()), pa.array(tail, pa.float64())], ["doc_id", "expected_grade", "tail_probability"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Ordinal | None:
    """A model of labelled rows; ``None`` without any.

    Null grades and ids are left out; of a document that is labelled twice
    each label counts. Of rows that repeat an id the one with the least text
    counts, so no more rows are fitted than labels are chosen.
    """
    chosen = labels.select(F.col(id_col).alias("_label_id"), F.col(grade_col).cast("double").alias("grade")).where("grade IS NOT NULL AND _label_id IS NOT NULL")
    chosen = common.hash_sample(chosen, sample_rows, "_label_id", "grade")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text"))
    # the chosen rows are few, so the sum over repeats is small
    rows = texts.join(F.broadcast(chosen.distinct()), F.col("_id") == F.col("_label_id")).groupBy("_id", "grade").agg(F.min("text").alias("text")).select(F.col("_id").cast("string").alias("id"), "grade", "text")
    found = rows.mapInArrow(_features, "id string, grade double, columns array<int>, values array<double>").toArrow().sort_by([("id", "ascending"), ("grade", "ascending")]).combine_chunks()
    if not len(found):
        return None
    columns, values = found.column("columns").combine_chunks(), found.column("values").combine_chunks()
    sizes, grades = np.diff(columns.offsets.to_numpy()), found.column("grade").to_numpy()
    return Ordinal.fit(sizes, columns.flatten().to_numpy(), values.flatten().to_numpy(), grades)


def grade(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text", keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """One row per input row: doc_id, expected_grade, tail_probability, kept.

    ``tail_probability`` is that of a grade above the lowest. Null and empty
    texts are graded as empty. Rows that repeat are graded alike. Without a
    model the numbers are null and everything is kept; with one grade only,
    everything has it and is kept. An empty table gives no row.
    """
    if model is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    graded = rows.mapInArrow(common.frugal(_grade(shared)), "doc_id long, expected_grade double, tail_probability double")
    return graded.withColumn("kept", F.col("tail_probability") >= keep_probability)


def keep_good(docs: DataFrame, model: Ordinal | None, text_col: str = "text", keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns stay."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    grade_texts = _grade(shared)

    @F.pandas_udf("boolean")
    def good(texts):
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])
        (out,) = grade_texts(iter([batch]))
        common.give_back()
        return out.column(2).to_pandas() >= keep_probability

    return docs.where(good(F.col(text_col).cast("binary")))


def op2_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, graded by what ``labels`` teach."""
    docs = common.table(spark, sf_dir, "documents")
    return grade(docs, fit(docs, common.table(spark, sf_dir, "labels")))
