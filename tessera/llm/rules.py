"""Operator 12: quality rules under weak supervision.

DataFrame functions only. Each rule looks at counts of a text and votes that
it is good, votes that it is poor, or abstains. Nobody says how far a rule is
to be trusted: expectation-maximisation estimates, from the votes of all rows,
how large a share of good texts there is and how often each rule's vote is
right on good and on poor texts. A row's posterior probability of being good
then takes the place of "all rules must pass".

Rows with the same votes are alike, so the rounds run over the distinct
patterns of votes with their numbers of rows: at most three to the power of
the number of rules, whatever the table's size. Texts are read once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS, MARKS = "[#*$%&|<>]", "[#*$%&|<>!]+"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
KEEP_PROBABILITY = 0.5
ROUNDS = 25
#: Where estimation starts: the share of good rows, and how often votes on good and on poor rows are right.
START_GOOD, START_RIGHT = 0.8, (0.98, 0.3)
#: Votes that each estimate of a rule's rightness starts with, so that none becomes certain.
PRIOR_VOTES = 2.0


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the counts: where it says poor, and else where it says good."""

    name: str
    poor: str
    good: str


#: Over the counts; each defect is seen by two rules at least, for only rules that agree tell EM that they are right.
RULES = (
    Rule("symbols", "20 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("marks", "5 * n_marks > n_words", "50 * n_marks <= n_words"),
    Rule("letters", "100 * n_letters < 90 * word_chars", "100 * n_letters >= 94 * word_chars"),
    Rule("shouts", "10 * n_shouts > n_words", "50 * n_shouts <= n_words"),
    Rule("capitals", "100 * n_capitals > 25 * word_chars", "100 * n_capitals <= 10 * word_chars"),
    Rule("repeats", "100 * n_repeat_words > 10 * n_words", "n_words >= 20 AND 100 * n_repeat_words <= 3 * n_words"),
    Rule("again", "100 * n_again > 10 * n_words", "50 * n_again <= n_words"),
    Rule("lines", "4 * n_dup_lines > n_lines", "n_lines >= 3 AND n_dup_lines = 0"),
    Rule("word_length", "word_chars > 15 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    Rule("length", "n_words < 20", "n_words >= 50"),
)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of each whole text that the rules look at; a null text is empty.

    Windows of words are told apart by 64-bit hashes; only texts in which one
    occurs twice are looked into further.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    number = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        number(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        number("!").alias("n_shouts"),
        number("[A-Z]").alias("n_capitals"),
        number(r"\p{L}").alias("n_letters"),
        number(MARKS).alias("n_marks"),
        F.size(F.filter(F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: a == b), lambda x: x)).cast("long").alias("n_again"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    starts = F.sequence(F.lit(0), F.size("hashes") - WINDOW)
    window = F.transform(starts, lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))
    rows = rows.withColumn("windows", F.when(F.size("hashes") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(placed)))
    after = F.slice("placed", 2, F.size("placed"))
    rows = rows.withColumn("same", F.zip_with("placed", after, lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    twice = F.zip_with("same", F.concat(F.array(F.lit(False)), "same"), lambda a, b: a | b)
    found = F.filter(F.zip_with("placed", twice, lambda p, t: F.when(t, p["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("starts", F.sort_array(found))
    # a window covers its words up to where the next begins
    covered = F.zip_with("starts", F.slice("starts", 2, F.size("starts")), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    repeat = F.aggregate(covered, F.lit(0), lambda n, x: n + x)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(repeat, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", "n_shouts", "n_capitals", "n_letters", "n_marks", "n_again")


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """1 for good, -1 for poor, 0 for abstaining, by rule; conditions that are null don't hold."""
    return [F.when(F.expr(r.poor), -1).when(F.expr(r.good), 1).otherwise(0) for r in rules]


@dataclass(frozen=True)
class Trust:
    """The share of good rows, and by rule how often its votes are right on good rows and on poor ones; no rule is held worse than chance."""

    good: float
    right: tuple[tuple[float, float], ...]

    def posterior(self, cast: list[str]) -> str:
        """SQL for the probability of being good, given the rules' votes, which are independent given what is true."""
        number = lambda x: f"{x!r}D"
        odds = [number(math.log(self.good / (1 - self.good)))]
        for vote, (on_good, on_poor) in zip(cast, self.right, strict=True):
            odds.append(f"CASE {vote} WHEN 1 THEN {number(math.log(on_good / (1 - on_poor)))} WHEN -1 THEN {number(math.log((1 - on_good) / on_poor))} ELSE 0D END")
        return f"1 / (1 + exp(-({' + '.join(odds)})))"


def start(rules: int) -> Trust:
    return Trust(START_GOOD, (START_RIGHT,) * rules)


def step(patterns: DataFrame, trust: Trust) -> Trust:
    """One round over ``patterns`` (v0, v1, ... and their number of rows n)."""
    cast = [f"v{k}" for k in range(len(trust.right))]
    sums = ["sum(n)", "sum(n * p)"]
    for vote in cast:
        for share, right in (("p", 1), ("(1 - p)", -1)):
            sums += [f"sum(CASE WHEN {vote} = {right} THEN n * {share} ELSE 0D END)", f"sum(CASE WHEN {vote} <> 0 THEN n * {share} ELSE 0D END)"]
    rows = patterns.sparkSession.sql(f"SELECT {', '.join(sums)} FROM (SELECT *, {trust.posterior(cast)} AS p FROM {{patterns}})", patterns=patterns)
    n, good, *each = rows.first()  # one row
    share = lambda hits, of, first: (hits + PRIOR_VOTES * first) / (of + PRIOR_VOTES)
    right = [tuple(share(each[4 * k + 2 * c], each[4 * k + 2 * c + 1], START_RIGHT[c]) for c in range(2)) for k in range(len(cast))]
    right = [(g, max(b, 1 - g)) for g, b in right]  # a poor vote never speaks for a row
    return Trust(share(good, n, START_GOOD), tuple(right))


def estimate(patterns: DataFrame, rules: int, rounds: int = ROUNDS) -> Trust:
    """What the votes of all rows say of the rules; without rows, where estimation starts."""
    trust = start(rules)
    if patterns.isEmpty():
        return trust
    # the patterns are few, and each round's numbers would be compiled anew
    with common.setting(patterns.sparkSession, "spark.sql.codegen.wholeStage", "false"):
        for _ in range(rounds):
            trust = step(patterns, trust)
    return trust


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS, keep_probability: float = KEEP_PROBABILITY) -> tuple[DataFrame, Trust]:
    """One row per input row: doc_id, the counts, base_failed, kept, posterior and the rules' votes; and the estimates.

    A null text is empty; an empty one has no words and fails the base. Rows
    that repeat are judged alike, and count as often as they stand. An empty
    table gives no row. ``kept`` is false where ``base_failed``, else whether
    the posterior is at least ``keep_probability``.
    """
    counted = common.materialize(counts(docs, id_col, text_col), "rules-counts")
    cast = votes(rules)
    patterns = counted.groupBy(*[v.alias(f"v{k}") for k, v in enumerate(cast)]).agg(F.count("*").alias("n"))
    patterns = common.materialize(patterns.coalesce(1).sortWithinPartitions(*[f"v{k}" for k in range(len(cast))]), "rules-patterns")
    trust = estimate(patterns, len(rules), rounds)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = counted.withColumn("base_failed", failed).withColumns({f"vote_{r.name}": v for r, v in zip(rules, cast, strict=True)})
    named = [f"vote_{r.name}" for r in rules]
    rows = rows.withColumn("posterior", F.expr(trust.posterior(named)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= keep_probability)).alias("kept"), "posterior", *named), trust


def _oracle() -> str:
    """The same in DuckDB: a round is one row of estimates."""
    k = len(RULES)
    case = "CASE WHEN {v} = 1 THEN ln({e}.g{i} / (1 - {e}.b{i})) WHEN {v} = -1 THEN ln((1 - {e}.g{i}) / {e}.b{i}) ELSE 0 END"
    posterior = lambda t, e: f"1 / (1 + exp(-(ln({e}.good / (1 - {e}.good)) + " + " + ".join(case.format(v=f"{t}.v{i}", e=e, i=i) for i in range(k)) + ")))"
    vote = ", ".join(f"CASE WHEN {r.poor} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS v{i}" for i, r in enumerate(RULES))
    names = ", ".join(f"v{i}" for i in range(k))
    steps = [
        r"""t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT r, i, words[i : i + 4] AS five FROM w, range(1, len(words) - 3) AS s(i)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, range(5) AS s(o) GROUP BY r),
c AS MATERIALIZED (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(text, '!')) AS n_shouts,
  len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, len(regexp_extract_all(text, '\p{L}')) AS n_letters,
  len(regexp_extract_all(text, '[#*$%&|<>!]+')) AS n_marks, len(list_filter(list_zip(words, words[2:]), lambda z: z[1] = z[2])) AS n_again FROM w LEFT JOIN rep USING (r))""",
        f"x AS MATERIALIZED (SELECT *, {vote} FROM c)",
        f"p AS MATERIALIZED (SELECT {names}, count(*) AS n FROM x GROUP BY ALL)",
        f"e0 AS MATERIALIZED (SELECT CAST({START_GOOD} AS DOUBLE) AS good, " + ", ".join(f"CAST({START_RIGHT[0]} AS DOUBLE) AS g{i}, CAST({START_RIGHT[1]} AS DOUBLE) AS b{i}" for i in range(k)) + ")",
    ]
    share = lambda hits, of, first: f"({hits} + {PRIOR_VOTES * first}) / ({of} + {PRIOR_VOTES})"
    for r in range(ROUNDS):
        each = []
        for i in range(k):
            g = share(f"coalesce(sum(n * q) FILTER (v{i} = 1), 0)", f"coalesce(sum(n * q) FILTER (v{i} <> 0), 0)", START_RIGHT[0])
            b = share(f"coalesce(sum(n * (1 - q)) FILTER (v{i} = -1), 0)", f"coalesce(sum(n * (1 - q)) FILTER (v{i} <> 0), 0)", START_RIGHT[1])
            each += [f"{g} AS g{i}", f"greatest({b}, 1 - {g}) AS b{i}"]
        steps.append(f"e{r + 1} AS MATERIALIZED (SELECT {share('sum(n * q)', 'sum(n)', START_GOOD)} AS good, {', '.join(each)} FROM (SELECT p.*, {posterior('p', 'e')} AS q FROM p, e{r} e))")
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed,\n  NOT {failed} AND {posterior('x', 'e')} >= {KEEP_PROBABILITY} AS kept FROM x, e{ROUNDS} e"


ORACLE_SQL = _oracle()


def op12_voting_rules(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, counted and judged by the rules' votes."""
    rows, _ = judge(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
