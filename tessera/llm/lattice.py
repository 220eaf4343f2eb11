"""Operator 9: language-model scores by subword lattices.

A word's probability is the sum over all its segmentations, by a forward
recursion in log space. The arcs are an existing vocabulary's pieces, whose
scores start the piece probabilities and which expected counts over the
distinct training words re-estimate, and the word as a whole with its
discounted training count. What discounting takes from counted words is the
weight of the segmentations into pieces. Pieces never cross words, so each
distinct word of the table is summed once, whoever uses it.

Training rows come in classes (their language), each with piece probabilities
and word counts of its own; a text's probability is marginal over the class
too, which is not an input of the score. Everything stays in log space, so a
word of any length keeps its own probability.

What is collected is one number a piece and class and a few a class. Word
counts stay distributed: the most frequent words' scores travel to every task,
up to a fixed number, and occurrences of all others meet theirs in a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

VOCABULARY = "piece_bpe_32k.model"
#: Stands before each word; it is no byte of UTF-8.
START = b"\xff"
ROUNDS = 3
#: Added to each expected piece count.
SMOOTHING = 0.01
#: A piece's rate of ending a word before any is counted, and the pieces' worth of the mean rate that each starts from.
FIRST_STOP, PRIOR_STOPS = 0.3, 2.0
#: Pieces' worth of all classes' shares that each class starts from.
PRIOR_PIECES = 300
#: Classes with rows of their own; all rarer ones are one class more.
MAX_CLASSES = 8
#: Weight of the counts of all classes within each class.
POOLED = 0.03
#: Bits of a slot in the tables that find pieces by hash.
SLOT_BITS = 19
#: The most frequent words, whose scores are broadcast, at most.
FREQUENT_WORDS = 200_000
#: Different words of a task that are counted together before they are handed on.
MAX_COUNTED_WORDS = 500_000
#: Bytes of words that go through the recursion together, and bytes of text that are split together.
GROUP_BYTES, BATCH_BYTES = 20_000, 6_000_000
FOLDS, HELD_OUT_FOLD = 7, 2

WORD_SCHEMA = "h long, known boolean, base double, s array<double>"
ROW_SCHEMA = "uid long, kind int, h long, tf long, doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, sums array<double>"
_P = np.uint64(0x9E3779B97F4A7C15)


def read_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, word starts as ``START``, and starting log probabilities.

    Pieces with A-Z, which lower-cased text never has, and pieces with a word
    start inside are left out. Every byte is a piece. Scores fall by one from
    merge to merge, so they are ranks, and a rank's weight is its inverse.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {bytes([b]): -float(model.get_piece_size()) for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        body = piece[1:] if piece.startswith("▁") else piece
        raw = (START if body is not piece else b"") + body.encode()
        if "▁" not in body and raw and raw == raw.lower():
            found[raw] = max(found.get(raw, -np.inf), model.get_score(i))
    weight = 1.0 / (2.0 - np.array(list(found.values())))
    return list(found), np.log(weight / weight.sum())


class Lattice:
    """Sums over all segmentations of words into pieces, for one or more classes of piece probabilities."""

    def __init__(self, pieces: list[bytes], uses: np.ndarray, lasts: np.ndarray) -> None:
        self.starts = np.array([p.startswith(START) for p in pieces])
        self.set(uses, lasts)
        self.longest = max(map(len, pieces))
        self._hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        # pieces by slots of their hash; those whose slot is taken go to the next table
        self._tables: list[tuple[np.uint64, np.ndarray]] = []
        left = np.arange(len(pieces), dtype=np.int32)
        while len(left):
            factor = np.uint64(2 * len(self._tables) + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            slot, table = self._slots(self._hashes[left], factor), np.full(1 << SLOT_BITS, -1, np.int32)
            table[slot] = left
            left = left[table[slot] != left]
            self._tables.append((factor, table))

    def set(self, uses: np.ndarray, lasts: np.ndarray) -> None:
        """Probabilities from uses (piece, class), of first pieces and of later ones, and from how many of them ended a word."""
        share = np.where(self.starts[:, None], uses / uses[self.starts].sum(axis=0), uses / uses[~self.starts].sum(axis=0))
        mean = lasts.sum(axis=0) / uses.sum(axis=0)
        stop = np.clip((lasts + PRIOR_STOPS * mean) / (uses + PRIOR_STOPS), 1e-6, 1 - 1e-6)
        # the last row is that of no piece
        self.logp = np.concatenate([np.log(np.maximum(share, 1e-300)) + np.log(1 - stop), np.full((1, uses.shape[1]), -np.inf)])
        self.stop = np.concatenate([np.log(stop / (1 - stop)), np.zeros((1, uses.shape[1]))])

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_P) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return (h + len(piece) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF

    @staticmethod
    def _slots(h: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((h * factor) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash; -1 for none."""
        found = np.full(h.shape, -1, np.int32)
        for factor, table in self._tables:
            at = table[self._slots(h, factor)]
            found = np.where((at >= 0) & (self._hashes[at] == h), at, found)
        return found

    def _arcs(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths that occur, and for each the pieces of all words' substrings by start; -1 for none."""
        m, n = words.shape
        wide = np.ascontiguousarray(words.T).astype(np.uint64) + np.uint64(1)
        h = np.zeros_like(wide)
        lengths, arcs = [], []
        for length in range(1, min(self.longest, n) + 1):
            h = h[: n - length + 1] * _P + wide[length - 1 :]
            found = self._find(h + np.uint64(length * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF))
            if (found >= 0).any():
                lengths.append(length)
                arcs.append(np.concatenate([found, np.full((length - 1, m), -1, np.int32)]))
        return np.array(lengths), np.stack(arcs)

    def _weigh(self, lengths: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        """Log weights of arcs in each class; those up to the end of the word stop there."""
        scores, n = self.logp[arcs], arcs.shape[1]
        each = np.arange(len(lengths))
        scores[each, n - lengths] += self.stop[arcs[each, n - lengths]]
        return scores

    @staticmethod
    def _sum(terms: np.ndarray) -> np.ndarray:
        top = terms.max(axis=0)
        return top + np.log(np.exp(terms - top).sum(axis=0))

    def _forward(self, lengths: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """Log sums over all segmentations of each beginning: (n + 1, word, class)."""
        alpha = np.zeros((n + 1, *scores.shape[2:]))
        for j in range(1, n + 1):
            k = int(np.searchsorted(lengths, j, side="right"))
            at = j - lengths[:k]
            alpha[j] = self._sum(alpha[at] + scores[np.arange(k), at])
        return alpha

    @staticmethod
    def _groups(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for same in np.split(order, cuts):
            n = int(sizes[same[0]]) + 1 if len(same) else 0
            step = max(1, GROUP_BYTES // max(1, n))
            for lo in range(0, len(same), step):
                some = same[lo : lo + step]
                yield some, np.frombuffer(b"".join(START + words[i] for i in some), np.uint8).reshape(len(some), n)

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's marginal probability in each class."""
        out = np.zeros((len(words), self.logp.shape[1]))
        for some, matrix in self._groups(words):
            lengths, arcs = self._arcs(matrix)
            out[some] = self._forward(lengths, self._weigh(lengths, arcs), matrix.shape[1])[-1]
        return out

    def expected(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, and uses at a word's end, by the first class' probabilities, each word counting with its weights (word, column)."""
        columns = weights.shape[1]
        total = np.zeros((len(self.logp) - 1, 2 * columns))
        for some, matrix in self._groups(words):
            n = matrix.shape[1]
            lengths, arcs = self._arcs(matrix)
            scores = self._weigh(lengths, arcs)[..., 0]
            alpha = self._forward(lengths, scores, n)
            beta = np.zeros_like(alpha)
            for i in range(n - 1, -1, -1):
                k = int(np.searchsorted(lengths, n - i, side="right"))
                beta[i] = self._sum(beta[i + lengths[:k]] + scores[:k, i])
            length, start, word = np.nonzero(arcs >= 0)
            share = np.exp(alpha[start, word] + scores[length, start, word] + beta[start + lengths[length], word] - alpha[-1][word])
            used = arcs[length, start, word]
            last = start + lengths[length] == n
            for c in range(columns):
                by = share * weights[some[word], c]
                total[:, c] += np.bincount(used, by, len(total))
                total[:, columns + c] += np.bincount(used[last], by[last], len(total))
        return total


def _split(texts: pa.Array) -> Iterator[tuple[int, pa.ListArray]]:
    """For some texts after others: where they begin, and their words."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (int(ends[lo - 1]) if lo else 0) + BATCH_BYTES, side="right")))
        # splitting leaves an empty word where white space begins or ends a text
        yield lo, pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts.slice(lo, hi - lo).view(pa.string()))))
        lo = hi


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["word", "class", "n"]
    held: list[pa.Table] = []
    rows = 0

    def out() -> pa.Table:
        found = pa.concat_tables(held).group_by(["word", "class"], use_threads=False).aggregate([("n", "sum")])
        return found.select(["word", "class", "n_sum"]).rename_columns(names)

    for batch in batches:
        kinds = batch.column(1).to_numpy()
        for lo, listed in _split(batch.column(0)):
            kind = np.repeat(kinds[lo : lo + len(listed)], pc.list_value_length(listed).to_numpy())
            found = pa.table({"word": listed.flatten().view(pa.binary()), "class": kind}).group_by(["word", "class"], use_threads=False).aggregate([([], "count_all")])
            held.append(found.select(["word", "class", "count_all"]).rename_columns(names))
            rows += len(held[-1])
            if rows > 2 * MAX_COUNTED_WORDS:
                held = [out()]
                rows = len(held[0])
                if rows > MAX_COUNTED_WORDS:
                    yield from held[0].combine_chunks().to_batches(100_000)
                    held, rows = [], 0
    if held:
        yield from out().combine_chunks().to_batches(100_000)


def _expect(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, uses, lasts, columns = shared.value
        lattice = common.kept("lattice", key, lambda _: Lattice(pieces, uses, lasts))
        total = np.zeros((len(pieces), 2 * columns))
        for batch in batches:
            if batch.num_rows:
                counts = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                weights = (counts > 0).astype(float) if columns > 1 else np.ones((batch.num_rows, 1))
                total += lattice.expected(tokens.values(batch.column(0)), weights)
        piece, column = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(column, pa.int32()), pa.array(total[piece, column])], ["piece", "column", "n"])

    return run


def word_hash(word: bytes) -> int:
    """64 bits of a word, signed, as they stand in the tables."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def log_scores(model: dict, counts: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """log10 probabilities of words in each class, from their counts and their segmentations' natural logs."""
    both = counts.sum(axis=1)[:, None]
    own = np.maximum(counts - model["discount"], 0) / model["total"]
    pooled = np.maximum(both - model["discount_all"], 0) / model["total_all"]
    with np.errstate(divide="ignore"):
        counted = np.log((1 - POOLED) * own + POOLED * pooled)
    rest = np.log((1 - POOLED) * model["reserve"] + POOLED * model["reserve_all"])
    return np.logaddexp(counted, rest + parts) / np.log(10)


def _score_words(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lattice = common.kept("lattice", key, lambda _: Lattice(model["pieces"], model["uses"], model["lasts"]))
        for batch in batches:
            words = tokens.values(batch.column(0))
            counts = batch.column(1).flatten().to_numpy().reshape(len(words), -1).astype(float)
            s = log_scores(model, counts, lattice.scores(words))
            seen = counts.sum(axis=1)
            h = np.fromiter(map(word_hash, words), np.int64, len(words))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * s.shape[1], pa.int32()), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(seen > 0), pa.array(np.log10(seen + 1) - model["floor"]), listed], ["h", "known", "base", "s"])

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        frequent, k = len(m["hash"]), len(m["end"])
        uid = TaskContext.get().partitionId() << 36
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
        names = [c.split()[0] for c in ROW_SCHEMA.split(", ")]
        for batch in batches:
            for lo, listed in _split(batch.column(2)):
                n = len(listed)
                counts = pc.list_value_length(listed).to_numpy().astype(np.int64)
                coded = listed.flatten().view(pa.binary()).dictionary_encode()
                words = tokens.values(coded.dictionary)
                real = np.fromiter(map(bool, words), bool, len(words))  # a text without words gives one empty one
                h = np.fromiter(map(word_hash, words), np.int64, len(words))
                at = np.minimum(np.searchsorted(m["hash"], h), max(0, frequent - 1))
                hit = (m["hash"][at] == h) if frequent else np.zeros(len(h), bool)
                code, doc = coded.indices.to_numpy(), np.repeat(np.arange(n), counts)
                values = np.zeros((len(words), k + 2))
                values[hit, :k], values[hit, k], values[hit, k + 1] = m["scores"][at[hit]], m["base"][at[hit]], m["known"][at[hit]]
                sums = np.stack([np.bincount(doc, column[code], n) for column in values.T], axis=1)
                sums[:, :k] += m["end"]
                sizes = np.bincount(doc, real[code], n).astype(np.int64) + 1
                uids = pa.array(uid + np.arange(n))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(sums[:, :k].ravel()))
                columns = [uids, pa.array(np.zeros(n, np.int32)), uids, pa.array(np.zeros(n, np.int64)), batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(sizes)]
                columns += [pa.array(sums[:, k + 1].astype(np.int64) + m["end_known"]), pa.array(sums[:, k] + m["end_base"]), flat]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds, strict=True)], names)
                rare = (~hit & real)[code]
                pairs, tf = np.unique(doc[rare] * len(words) + code[rare], return_counts=True)
                if len(pairs):
                    columns = [pa.array(uid + pairs // len(words)), pa.array(np.ones(len(pairs), np.int32)), pa.array(h[pairs % len(words)]), pa.array(tf.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns + [pa.nulls(len(pairs), t) for t in kinds[4:]], names)
                uid += n

    return run


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", vocabulary: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities. Null and empty texts are one end token.
    Rows that repeat an id are scored each; a null id counts by the text
    ``null``. Null is a class of its own; without the class column, or with
    ``None``, all rows are one class. The ``MAX_CLASSES`` classes with most
    rows have pieces' rates of their own; all rarer ones are one class more,
    so a text of a rare class is scored by what its like have in common. The
    class is no input of a score. Without training rows the starting
    probabilities score. An empty table gives no row.
    """
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % FOLDS == HELD_OUT_FOLD
    kind = F.coalesce(F.col(class_col).cast("string"), F.lit("")) if class_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("binary").alias("text"), kind.alias("kind"))
    by_kind = rows.where(~F.col("held_out")).groupBy("kind").count()
    found = by_kind.orderBy(F.desc("count"), "kind").limit(MAX_CLASSES).collect()
    names, ends_all = [r["kind"] for r in found], by_kind.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    ends = [r["count"] for r in found]
    if ends_all > sum(ends) or not ends:
        ends.append(ends_all - sum(ends))
    ends, k = np.array(ends, float), len(ends)
    number = F.coalesce(*[F.when(F.col("kind") == n, F.lit(i)) for i, n in enumerate(names)], F.lit(k - 1))
    # words of held-out rows are listed without counts
    counted = rows.select("text", F.when(F.col("held_out"), -1).otherwise(number).cast("int").alias("class")).mapInArrow(_count_words, "word binary, class int, n long")
    by_class = F.array(*[F.sum(F.when(F.col("class") == i, F.col("n")).otherwise(0)) for i in range(k)])
    words = common.materialize(counted.where(F.octet_length("word") > 0).groupBy("word").agg(by_class.alias("c")), "lm-words")
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    columns = [*[F.col("c")[i] for i in range(k)], add(F.col("c"))]
    what = [x for c in columns for x in (F.coalesce(F.sum(c), F.lit(0)), F.count_if(c > 0), F.count_if(c == 1), F.count_if(c == 2))]
    facts = np.array(words.agg(*[x.alias(f"x{i}") for i, x in enumerate(what)]).first(), np.int64).reshape(-1, 4)
    seen, distinct_words = int(facts[-1][0]), int(facts[-1][1])
    total, distinct = seen + ends_all, distinct_words + bool(ends_all)
    floor = float(np.log10(total + distinct + 1))

    pieces, logp = read_vocabulary(vocabulary or tokens.vocabulary_path(VOCABULARY))
    uses = np.exp(logp)[:, None]
    lasts = uses * FIRST_STOP
    taught = words.where(add(F.col("c")) > 0)
    for turn in range(rounds if seen else 0):
        wide = k if turn == rounds - 1 else 1  # the last round counts by class
        shared = spark.sparkContext.broadcast((pieces, uses, lasts, wide))
        fresh = np.zeros((len(pieces), 2 * wide))
        with common.short_batches(spark, 20_000):
            for piece, column, n in taught.mapInArrow(_expect(shared, uuid.uuid4().hex), "piece int, column int, n double").groupBy("piece", "column").agg(F.sum("n").alias("n")).collect():  # one row a piece and class
                fresh[piece, column] += n
        shared.destroy()
        uses, lasts = fresh[:, :wide] + SMOOTHING, fresh[:, wide:] + SMOOTHING * FIRST_STOP
    # every class starts from some of what all classes have
    prior = [x.sum(axis=1, keepdims=True) * (PRIOR_PIECES / uses.sum()) for x in (uses, lasts)]
    uses, lasts = ((x if seen and rounds else np.zeros((len(pieces), k))) + y for x, y in zip((uses, lasts), prior, strict=True))
    totals = np.maximum(facts[:, 0] + np.append(ends, ends_all), 1.0)
    discounts = np.array([_discount(a, b) for a, b in facts[:, 2:]])
    reserves = np.where(facts[:, 1] > 0, discounts * facts[:, 1] / totals, 1e-3)
    end = (1 - POOLED) * ends / totals[:-1] + POOLED * ends_all / totals[-1]
    model = {
        "pieces": pieces, "uses": uses, "lasts": lasts, "floor": floor, "total": totals[:-1], "total_all": totals[-1],
        "discount": discounts[:-1], "discount_all": discounts[-1], "reserve": reserves[:-1], "reserve_all": reserves[-1],
    }
    shared = spark.sparkContext.broadcast(model)
    counts = common.materialize(words.mapInArrow(_score_words(shared, uuid.uuid4().hex), WORD_SCHEMA), "lm-scores")
    # the most frequent words by a threshold on their count: no task sends more than is kept
    step = F.floor(F.col("base") * 32).cast("long")
    steps = sorted(((r["s"], r["n"]) for r in counts.where("known").groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)  # at most a few hundred rows
    kept, least = 0, None
    for s, n in steps:
        kept += n
        if kept > FREQUENT_WORDS:
            break
        least = s
    frequent = counts.where((step >= least) & F.col("known") if least is not None else F.lit(False)).toArrow()
    h = frequent.column("h").to_numpy()
    order = np.argsort(h)
    top = {
        "hash": h[order], "scores": frequent.column("s").combine_chunks().flatten().to_numpy().reshape(-1, k)[order], "base": frequent.column("base").to_numpy()[order],
        "known": np.ones(len(h)), "end": np.log10(np.maximum(end, 1e-9)), "end_base": float(np.log10(ends_all + 1) - floor), "end_known": int(ends_all > 0),
    }
    scored = rows.select("doc_id", "held_out", "text").mapInArrow(_score(spark.sparkContext.broadcast(top)), ROW_SCHEMA)
    joined = scored.join(counts.withColumn("kind", F.lit(1)), ["h", "kind"], "left")
    rare = F.col("kind") == 1
    out = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(rare, F.when(F.col("known"), F.col("tf")).otherwise(0)).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(rare, F.col("tf") * F.col("base")).otherwise(F.col("base_sum"))).alias("base_score"),
        *[F.sum(F.when(rare, F.col("tf") * F.col("s")[i]).otherwise(F.col("sums")[i])).alias(f"s{i}") for i in range(k)],
    )
    prior = np.log10(np.maximum(ends, 1e-9) / max(ends.sum(), 1.0))
    logs = [F.col(f"s{i}") + F.lit(float(prior[i])) for i in range(k)]
    best = F.greatest(*logs) if k > 1 else logs[0]
    score = best + F.log10(sum((F.pow(F.lit(10.0), x - best) for x in logs), F.lit(0.0)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", score.alias("score"))


def op9_lattice_lm(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, scored by what their training folds teach."""
    return lm_scores(common.table(spark, sf_dir, "documents"))
