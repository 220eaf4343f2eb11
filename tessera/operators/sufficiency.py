"""Whether evidence suffices: features, model, threshold, metrics, decision."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.checkpoints import cut
from ..functions.sizes import maybe_broadcast

FEATURES = ("evidence_count", "log_evidence_word_count", "question_content_coverage", "citation_label_content_coverage", "evidence_content_density")
ITERATIONS, LEARNING_RATE, L2_PENALTY = 2500, 0.05, 0.01
#: Different rows that the published recipe fits in one place.
MAX_LOCAL_ROWS = 200_000


def features(question: Column, texts: Column, labels: Column) -> dict[str, Column]:
    """The five features of a question and its evidence, as columns."""
    cited, named = F.array_join(texts, "\n"), F.array_join(labels, "\n")
    asked, found, words = T.content_tokens(question), T.content_tokens(cited), T.word_tokens(cited)
    share = lambda have: F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, have)) / F.size(asked)).otherwise(0.0)
    columns = F.size(texts).cast("double"), F.log1p(F.size(words).cast("double")), share(found), share(T.content_tokens(named)), F.size(found) / F.greatest(F.lit(1), F.size(words))
    return dict(zip(FEATURES, columns, strict=True))


def standardization(rows: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row: mean_* and scale_* (population deviation; 1 where that is 0)."""
    scale = lambda n: F.when(F.stddev_pop(n) == 0, 1.0).otherwise(F.stddev_pop(n))
    return rows.agg(*[F.avg(n).alias(f"mean_{n}") for n in names], *[scale(n).alias(f"scale_{n}") for n in names])


def standardize(rows: DataFrame, facts: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    kept = [c for c in rows.columns if c not in names]
    return rows.crossJoin(F.broadcast(facts)).select(*kept, *[((F.col(n) - F.col(f"mean_{n}")) / F.col(f"scale_{n}")).alias(n) for n in names])


@dataclass(frozen=True)
class Model:
    """A logistic model over standardised features, with its threshold."""

    coefficients: tuple[float, ...]
    intercept: float
    means: tuple[float, ...]
    scales: tuple[float, ...]
    threshold: float = 0.5

    def __post_init__(self) -> None:
        sizes = {len(self.coefficients), len(self.means), len(self.scales)}
        numbers = [*self.coefficients, self.intercept, *self.means, *self.scales]
        if len(sizes) != 1 or not np.isfinite(numbers).all() or min(self.scales) <= 0 or not 0 <= self.threshold <= 1:
            raise ValueError("a model needs finite numbers, scales above 0 and a threshold in 0..1")

    def probability(self, columns: dict[str, Column]) -> Column:
        value = F.lit(float(self.intercept))
        for c, m, s, x in zip(self.coefficients, self.means, self.scales, columns.values(), strict=True):
            value = value + F.lit(float(c)) * ((x - F.lit(float(m))) / F.lit(float(s)))
        return T.sigmoid(value)


def _sums(values: list[Column], weight: Column, rest: Column) -> list[Column]:
    """The gradient's and, row by row, the upper triangle of the Hessian's sums."""
    first = [F.sum(rest * v) for v in values]
    return first + [F.sum(weight * values[i] * values[j]) for i in range(len(values)) for j in range(i, len(values))]


def fit_newton(rows: DataFrame, names: tuple[str, ...] = FEATURES, target: str = "target", penalty: float = L2_PENALTY, tolerance: float = 1e-10, rounds: int = 50) -> Model:
    """The logistic model of least penalised loss on standardised rows; the intercept isn't penalised.

    Newton's steps: each is one pass that sums outer products of the rows, one
    small row a task, so any number of rows may be fitted and none leaves the
    executors. A step that doesn't lower the loss is halved. With a penalty
    the optimum is unique. The features are put together and written once; the
    passes read those few numbers a row.
    """
    rows = cut(rows.select(*names, target))
    facts = rows.agg(F.count("*").alias("n"), F.sum(target).alias("t"), F.sum(F.when(F.col(target).isin(0, 1), 0).otherwise(1)).alias("odd")).first()
    if not facts["n"] or facts["odd"] or not 0 < facts["t"] < facts["n"]:
        raise ValueError("training rows must have both classes")
    scale = standardization(rows, names).first()
    means, scales = [scale[f"mean_{n}"] for n in names], [scale[f"scale_{n}"] for n in names]
    n, share = facts["n"], facts["t"] / facts["n"]
    values = [*[(F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(names, means, scales, strict=True)], F.lit(1.0)]
    size = len(values)
    held = np.append(np.full(size - 1, penalty), 0.0)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and Hessian, each a mean over the rows."""
        z = sum((F.lit(float(c)) * v for c, v in zip(w, values, strict=True)), F.lit(0.0))
        p = T.sigmoid(z)
        # log(1 + e**z) - y z without overflow
        loss = F.sum(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col(target) * z)
        sums = [loss, *_sums(values, p * (1 - p), p - F.col(target))]
        found = np.array(rows.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first(), float) / n
        hessian = np.zeros((size, size))
        hessian[np.triu_indices(size)] = found[size + 1 :]
        hessian = hessian + np.triu(hessian, 1).T
        return found[0] + (held * w * w).sum() / 2, found[1 : size + 1] + held * w, hessian + np.diag(held)

    w = np.append(np.zeros(size - 1), np.log(share / (1 - share)))
    loss, gradient, hessian = at(w)
    for _ in range(rounds):
        if np.abs(gradient).max() < tolerance:
            break
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        while True:
            new = at(w - step)
            if new[0] <= loss or np.abs(step).max() < tolerance:
                break
            step = step / 2
        w, (loss, gradient, hessian) = w - step, new
    return Model(tuple(w[:-1].tolist()), float(w[-1]), tuple(means), tuple(scales))


def fit(rows: DataFrame, names: tuple[str, ...] = FEATURES, target: str = "target", iterations: int = ITERATIONS, rate: float = LEARNING_RATE, penalty: float = L2_PENALTY) -> Model:
    """The published recipe: a fixed number of full-batch gradient steps on standardised rows; the intercept isn't penalised.

    It stops short of :func:`fit_newton`'s optimum. Rows with the same features
    and target count once with their number. Up to ``MAX_LOCAL_ROWS`` of them,
    as labels given by hand are, are fitted in one place; beyond that each step
    is a pass of sums over all rows.
    """
    grouped = cut(rows.groupBy(*names, target).agg(F.count("*").cast("double").alias("_n")))
    facts = grouped.agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col(target)).alias("t"), F.sum(F.when(F.col(target).isin(0, 1), 0).otherwise(1)).alias("odd")).first()
    if not facts["n"] or facts["odd"] or not 0 < facts["t"] < facts["n"]:
        raise ValueError("training rows must have both classes")
    total, share = facts["n"], facts["t"] / facts["n"]
    if grouped.limit(MAX_LOCAL_ROWS + 1).count() <= MAX_LOCAL_ROWS:
        data = grouped.select(*names, target, "_n").toPandas().to_numpy(float)
        data = data[np.lexsort(data.T)]
        x, y, n = data[:, :-2], data[:, -2], data[:, -1]
        means = n @ x / total
        scales = np.sqrt(n @ (x - means) ** 2 / total)
        scales[scales == 0] = 1.0
        z = (x - means) / scales

        def slopes(w: np.ndarray, b: float) -> np.ndarray:
            error = n * (1 / (1 + np.exp(-(z @ w + b))) - y) / total
            return np.append(z.T @ error, error.sum())
    else:
        n, centre = F.col("_n"), grouped.agg(*[F.sum(F.col("_n") * F.col(c)) / total for c in names]).first()
        means = np.array(centre, float)
        spread = grouped.agg(*[F.sum(n * (F.col(c) - F.lit(float(m))) ** 2) / total for c, m in zip(names, means, strict=True)]).first()
        scales = np.sqrt(np.array(spread, float))
        scales[scales == 0] = 1.0
        values = [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(names, means, scales, strict=True)]

        def slopes(w: np.ndarray, b: float) -> np.ndarray:
            p = T.sigmoid(sum((F.lit(float(c)) * v for c, v in zip(w, values, strict=True)), F.lit(float(b))))
            error = n * (p - F.col(target)) / total
            return np.array(grouped.agg(*[F.sum(error * v) for v in values], F.sum(error)).first(), float)

    w, b = np.zeros(len(names)), float(np.log(share / (1 - share)))
    for _ in range(iterations):
        found = slopes(w, b)
        b -= rate * found[-1]
        w = w - rate * (found[:-1] + penalty * w)
    return Model(tuple(w.tolist()), float(b), tuple(means.tolist()), tuple(scales.tolist()))


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Confusion counts and rates of target and prediction, to 12 digits; 0 where a rate is undefined."""
    t, p = F.col("target") == 1, F.col("prediction") == 1
    out = rows.groupBy(*by).agg(F.count("*").alias("case_count"), F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    rate = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    recall, special, precision = rate(tp, fn), rate(tn, fp), rate(tp, fp)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return out.select(
        *by, "case_count", "tp", "tn", "fp", "fn", T.round12((tp + tn) / F.col("case_count")).alias("accuracy"), T.round12((recall + special) / 2).alias("balanced_accuracy"),
        T.round12(precision).alias("precision"), T.round12(recall).alias("recall"), T.round12(f1).alias("f1"),
    )


def thresholds(scored: DataFrame) -> DataFrame:
    """Candidates with metrics: 0, 1/2, 1, each probability and each midpoint.

    Distinct probabilities with their counts are dealt by ranges. A
    threshold's counts are those of its own range from it upwards and the sums
    of all higher ranges, so no task sees all probabilities and rows aren't
    compared with thresholds. ``scored`` has target and probability.
    """
    p = F.col("probability")
    grouped = scored.where(p.isNotNull()).groupBy("probability").agg(F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") == 0).alias("neg"))
    rows = cut(grouped.repartitionByRange("probability").withColumn("part", F.spark_partition_id()))
    # one row a range from here ...
    ranges = rows.groupBy("part").agg(F.min(p).alias("first"), F.sum("pos").alias("part_pos"), F.sum("neg").alias("part_neg"))
    later, every = Window.orderBy(F.desc("part")), Window.partitionBy()
    above = later.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "part", F.lag("first").over(later).alias("after"), F.coalesce(F.sum("part_pos").over(above), F.lit(0)).alias("pos_above"), F.coalesce(F.sum("part_neg").over(above), F.lit(0)).alias("neg_above"),
        F.sum("part_pos").over(every).alias("p"), F.sum("part_neg").over(every).alias("n"),
    )
    # ... to here
    within = Window.partitionBy("part").orderBy(F.desc("probability"))
    upward = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(maybe_broadcast(ranges), "part").withColumn("tp", F.col("pos_above") + F.sum("pos").over(upward)).withColumn("fp", F.col("neg_above") + F.sum("neg").over(upward))
    middle = (p + F.coalesce(F.lag("probability").over(within), F.col("after"))) / 2
    rows = rows.withColumn("middle", middle)
    at_middle = rows.where(F.col("middle") > p).select(F.col("middle").alias("threshold"), (F.col("tp") - F.col("pos")).alias("tp"), (F.col("fp") - F.col("neg")).alias("fp"), "p", "n")
    fixed = [grouped.agg(F.lit(t).alias("threshold"), *[F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0)).alias(a) for a, x, c in (("tp", "pos", p >= t), ("fp", "neg", p >= t), ("p", "pos", F.lit(True)), ("n", "neg", F.lit(True)))]) for t in (0.0, 0.5, 1.0)]
    rows = rows.select(p.alias("threshold"), "tp", "fp", "p", "n").union(at_middle)
    for row in fixed:
        rows = rows.union(row)
    rows = rows.distinct()
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    recall, special, precision = rate(F.col("tp"), F.col("p")), rate(F.col("n") - F.col("fp"), F.col("n")), rate(F.col("tp"), F.col("tp") + F.col("fp"))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.select("threshold", T.round12((recall + special) / 2).alias("balanced_accuracy"), T.round12(f1).alias("f1"))


def best_threshold(candidates: DataFrame) -> DataFrame:
    """One row: the best balanced accuracy, then F1, then nearest to 1/2, then largest."""
    key = F.struct("balanced_accuracy", "f1", (-F.abs(F.col("threshold") - 0.5)).alias("near"), "threshold")
    return candidates.agg(F.max(key).alias("k")).select("k.threshold", "k.balanced_accuracy", "k.f1")


def silver_label(codes: Column) -> Column:
    """Status by the rule of construction; null if the codes name neither kind."""
    return F.when(F.array_contains(codes, "incomplete_evidence_set"), "insufficient").when(F.arrays_overlap(codes, F.array(F.lit("one_complete_passage"), F.lit("multiple_complementary_passages"))), "sufficient")


def silver_violations(cases: DataFrame) -> DataFrame:
    """case_id and rule of cases that the rule can't label."""
    codes = F.col("evidence_structure_codes")
    incomplete = F.array_contains(codes, "incomplete_evidence_set")
    rule = (
        F.when(incomplete & ~F.array_contains(codes, "strict_subset_of_complete_evidence"), "not a strict subset").when(incomplete & F.col("complete_reference_case_id").isNull(), "no complete case")
        .when(silver_label(codes).isNull(), "no complete structure")
    )
    return cases.select("case_id", rule.alias("rule")).where("rule IS NOT NULL")


def reference_violations(cases: DataFrame) -> DataFrame:
    """case_id and rule of incomplete cases against the complete case that they name."""
    right = cases.select(F.col("case_id").alias("complete_reference_case_id"), F.col("query_id").alias("_q"), F.col("evidence_passage_ids").alias("_e"))
    rows = cases.where("complete_reference_case_id IS NOT NULL").join(right, "complete_reference_case_id", "left")
    mine, whole = F.col("evidence_passage_ids"), F.col("_e")
    strict = (F.size(F.array_except(mine, whole)) == 0) & (F.size(F.array_except(whole, mine)) > 0)
    rule = F.when(whole.isNull(), "no such case").when(F.col("_q") != F.col("query_id"), "another query").when(~strict, "not a strict subset")
    return rows.select("case_id", rule.alias("rule")).where("rule IS NOT NULL")
