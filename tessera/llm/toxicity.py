"""Operator 6: toxicity by gradient-boosted trees over dense features.

A short list of insults is extended by what labelled rows teach: words and
word beginnings that toxic texts have far more often. Densities of its terms, as written and with
obfuscation undone, their closeness to second-person words, and rates of
capitals, punctuation and obfuscated words are a text's features. Small trees
are boosted on them and their sum is calibrated by isotonic regression.

Lexicon, trees and calibration each learn from other labelled rows, all among
at most ``SAMPLE_ROWS``, those with the least hash of their id, and none from
the held-out fold. Scores cover every row and its whole text.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 15_000
HELD_OUT_MODULUS = 5
#: Terms of the learned lexicon, and the toxic texts that a term must be in.
LEXICON_TERMS, MIN_TEXTS = 300, 4
STRONG, MILD = 3.0, 1.2
NEAR = 4
TREES, DEPTH, RATE, BINS, MIN_LEAF, L2 = 80, 3, 0.15, 32, 12, 1.0
MAX_CACHED_WORDS = 150_000

#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu toi te ton ta tes vous votre vos "
    "tú ti tuyo usted ustedes vosotros os vuestro".split()
)
#: Insults that are in the lexicon from the start, with this weight.
SEED_WEIGHT = 3.5
SEED_TERMS = (
    "idiot idiots moron morons stupid loser losers pathetic worthless disgusting trash scum clown garbage dumb jerk bastard bitch shit fuck fucking "
    "asshole crap imbecile dumm dummkopf arschloch scheiße idiota imbécil estúpido mierda imbécile connard merde salaud"
).split()
#: Signs that stand for letters.
_LEET = bytes.maketrans(b"013457@$!|", b"oieastasil")
_LETTERS = re.compile(r"[^\W\d_]+")
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = b"abcdefghijklmnopqrstuvwxyz"
_DIGITS = b"0123456789"
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STRONG_BIT, MILD_BIT, HIDDEN_BIT, PERSON_BIT, CAPS_BIT, ODD_BIT = 1, 2, 4, 8, 16, 32
FEATURES = (
    "strong_density", "strong_count", "mild_density", "mild_count", "hidden_density", "hidden_count", "near_person_density", "person_density",
    "capital_rate", "capital_words", "exclamations", "punctuation", "digits", "obfuscated", "log_words",
)


def plain(word: bytes) -> str:
    """A word in lower case without punctuation at its ends."""
    return word.decode("utf-8", "replace").lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”’")


def revealed(word: bytes) -> str:
    """A word with signs read as letters and everything else but letters gone."""
    core = word.rstrip(b".,;:!?").translate(_LEET).decode("utf-8", "replace").lower()
    return "".join(_LETTERS.findall(core))


def terms(word: str) -> tuple[str, ...]:
    """What a word is in a lexicon by: itself and its beginnings."""
    return (word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)) if len(word) > 2 else ()


class _Codes(dict):
    """Bits of words, kept up to a bound."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self._lexicon = lexicon

    def weight(self, word: str) -> float:
        return max((self._lexicon.get(t, 0.0) for t in terms(word)), default=0.0)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        text = plain(word)
        w = self.weight(text)
        code = STRONG_BIT if w >= STRONG else MILD_BIT if w >= MILD else 0
        core = word.strip(_PUNCTUATION)
        odd = not core.isalpha() and core.isascii() and any(65 <= b <= 122 for b in core) and not core.replace(b"'", b"").replace(b"-", b"").isalpha()
        if odd:
            code |= ODD_BIT
        if not code & STRONG_BIT and (odd or not word.isalpha()) and self.weight(revealed(word)) >= STRONG:
            code |= HIDDEN_BIT
        if text in SECOND_PERSON:
            code |= PERSON_BIT
        if len(core) > 1 and text.upper() == word.decode("utf-8", "replace").strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”’") and text.upper() != text:
            code |= CAPS_BIT
        self[word] = code
        return code


def features(text: bytes, codes: _Codes) -> list[float]:
    """Dense features of a text, in the order of ``FEATURES``."""
    words = text.split()
    n = max(1, len(words))
    bits = np.fromiter(map(codes.__getitem__, words), np.uint8, len(words))
    count = lambda b: int(np.count_nonzero(bits & b))
    strong, mild, hidden, person = count(STRONG_BIT), count(MILD_BIT), count(HIDDEN_BIT), count(PERSON_BIT)
    near = 0
    if person and (strong or hidden or mild):
        hits, people = np.flatnonzero(bits & (STRONG_BIT | HIDDEN_BIT | MILD_BIT)), np.flatnonzero(bits & PERSON_BIT)
        near = int((np.searchsorted(people, hits + NEAR, "right") > np.searchsorted(people, hits - NEAR)).sum())
    gone = lambda chars: len(text) - len(text.translate(None, chars))
    upper, lower, size = gone(_UPPER), gone(_LOWER), max(1, len(text))
    return [
        strong / n, float(strong), mild / n, float(mild), hidden / n, float(hidden), near / n, person / n, upper / max(1, upper + lower), count(CAPS_BIT) / n,
        text.count(b"!") / size, gone(_PUNCTUATION) / size, gone(_DIGITS) / size, count(ODD_BIT) / n, float(np.log1p(len(words))),
    ]


@dataclass
class Boosted:
    """Trees over binned features, an offset, and the calibration's steps."""

    lexicon: dict[str, float]
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[int, int, float]]] = field(default_factory=list)
    offset: float = 0.0
    at: np.ndarray = field(default_factory=lambda: np.zeros(0))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, total = self.bins(x), np.full(len(x), self.offset)
        for tree in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                split = np.array([t[0] for t in tree])[node]
                cut = np.array([t[1] for t in tree])[node]
                node = np.where(split < 0, node, 2 * node + 1 + (b[np.arange(len(x)), np.maximum(split, 0)] > cut))
            total += np.array([t[2] for t in tree])[node]
        return total

    def fit_trees(self, x: np.ndarray, y: np.ndarray) -> None:
        """Newton boosting of the logistic loss; leaves are in heap order."""
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        self.edges = [np.unique(np.concatenate([e, [0.0]])) if (x[:, j] > 0).any() else e for j, e in enumerate(self.edges)]
        b = self.bins(x)
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.offset = float(np.log(rate / (1 - rate)))
        total = np.full(len(y), self.offset)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            tree = [(-1, 0, 0.0)] * (2 ** (DEPTH + 1) - 1)
            node = np.zeros(len(y), np.int64)
            for k in range(2**DEPTH - 1):
                on = np.flatnonzero(node == k)
                best = (1e-6, -1, 0)
                if len(on) >= 2 * MIN_LEAF:
                    score = lambda a, c: a * a / (c + L2)
                    for j in range(x.shape[1]):
                        size = len(self.edges[j]) + 1
                        n = np.bincount(b[on, j], minlength=size).cumsum()[:-1]
                        a = np.bincount(b[on, j], g[on], size).cumsum()
                        c = np.bincount(b[on, j], h[on], size).cumsum()
                        if size < 2:
                            continue
                        gain = score(a[:-1], c[:-1]) + score(a[-1] - a[:-1], c[-1] - c[:-1]) - score(a[-1], c[-1])
                        gain[(n < MIN_LEAF) | (len(on) - n < MIN_LEAF)] = -1
                        cut = int(gain.argmax())
                        if gain[cut] > best[0]:
                            best = (float(gain[cut]), j, cut)
                if best[1] >= 0:
                    tree[k] = (best[1], best[2], 0.0)
                    node[on] = 2 * k + 1 + (b[on, best[1]] > best[2])
            for k in np.unique(node).tolist():
                on = node == k
                tree[k] = (-1, 0, float(RATE * g[on].sum() / (h[on].sum() + L2)))
            total += np.array([t[2] for t in tree])[node]
            self.trees.append(tree)

    def calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        """Isotonic regression by pooling adjacent violators, with one pseudo-row of either class."""
        order = np.argsort(raw, kind="stable")
        blocks: list[list[float]] = []
        for r, t in zip(raw[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([r, r, t, 1.0])
            while len(blocks) > 1 and (blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3] or blocks[-2][1] == blocks[-1][0]):
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
        self.at = np.array([x for lo, hi, _, _ in blocks for x in (lo, hi)])
        self.value = np.array([v for _, _, s, n in blocks for v in [(s + 0.05) / (n + 0.1)] * 2])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; the calibration is linear between its steps."""
        raw = self.raw(x) if self.trees else np.full(len(x), self.offset)
        smooth = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        if not len(self.at):
            return smooth
        return np.clip(0.98 * np.interp(raw, self.at, self.value) + 0.02 * smooth, 0.0, 1.0)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = {plain(w) for w in (text.as_py() or b"").split()}
            counts[toxic].update({t for w in words for t in terms(w)})
    names = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in counts]], ["term", "clean", "toxic"])


def _dense(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(shared.value.lexicon)
        for batch in batches:
            rows = [features(t.as_py() or b"", codes) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "turn", "x"])

    return run


def _predict(shared):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        codes = common.kept("toxicity", key, lambda _: _Codes(model.lexicon))
        for batch in batches:
            rows = [features(t.as_py() or b"", codes) for t in batch.column(2)]
            score = model.score(np.array(rows).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Boosted:
    """A model of the labelled rows outside the held-out fold.

    Null labels and ids are left out; of rows that repeat an id the one with
    the least text counts. Without rows of both classes the score
    is one number, the share of toxic rows, or one half without any rows.
    """
    spark = docs.sparkSession
    chosen = labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic IN (0, 1) AND _label_id IS NOT NULL")
    chosen = common.hash_sample(chosen.where(common.crc_mod("_label_id", HELD_OUT_MODULUS) != 0), sample_rows, "_label_id", "toxic")
    turn = F.pmod(F.xxhash64(F.lit(3), "_label_id"), F.lit(20)).cast("int").alias("turn")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(chosen.distinct()), F.col("_id") == F.col("_label_id")).groupBy("_label_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", turn)
    rows = common.materialize(rows, "toxic-sample")
    sizes = {(r["toxic"], r["turn"] < 8): r["n"] for r in rows.groupBy("toxic", (F.col("turn") < 8).alias("turn")).agg(F.count("*").alias("n")).withColumn("turn", F.when(F.col("turn"), 0).otherwise(8)).collect()}
    toxic, clean = sizes.get((1, True), 0), sizes.get((0, True), 0)
    model = Boosted(dict.fromkeys(SEED_TERMS, SEED_WEIGHT))
    if toxic and clean:
        found = rows.where("turn < 8").select("text", "toxic").mapInArrow(_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
        found = found.where(F.col("toxic") >= MIN_TEXTS).withColumn("odds", odds).where(F.col("odds") >= MILD)
        best = found.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(LEXICON_TERMS).collect()
        model.lexicon |= {r["term"]: float(r["odds"]) for r in best}
    shared = spark.sparkContext.broadcast(model)
    data = rows.where("turn >= 8").mapInArrow(_dense(shared), "toxic int, turn int, x array<double>").toPandas()
    if not len(data) or data["toxic"].nunique() < 2:
        rate = (data["toxic"].mean() * len(data) + 0.5) / (len(data) + 1) if len(data) else 0.5
        model.offset = float(np.log(rate / (1 - rate)))
        return model
    x, y = np.stack(data["x"].to_numpy()), data["toxic"].to_numpy(float)
    order = np.lexsort([*x.T, y])
    x, y, last = x[order], y[order], data["turn"].to_numpy()[order] >= 16
    if len(set(y[~last])) < 2 or len(set(y[last])) < 2:
        model.fit_trees(x, y)
        return model
    model.fit_trees(x[~last], y[~last])
    model.calibrate(model.raw(x[last]), y[last])
    return model


def score(docs: DataFrame, model: Boosted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts are scored as empty ones. Rows that repeat are scored
    alike; a null id is not held out. An empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = F.coalesce(common.crc_mod(id_col, HELD_OUT_MODULUS) == 0, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    out = rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op6_boosted_toxicity(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, scored by what ``labels`` outside the held-out fold teach."""
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
