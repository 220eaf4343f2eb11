"""Quality rules under weak supervision against brute force."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import catalog, rules

SCHEMA = "doc_id long, text string"


def brute_counts(text):
    text = text or ""
    words, blanks = [w.decode() for w in text.encode().split()], " \t\n\x0b\x0c\r"
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + o for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for o in range(5)}
    lines = [x for x in text.split("\n") if x.strip(blanks)]
    return len(words), sum(c not in blanks for c in text), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts(seed=2):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "né") for b in ("ran", "sel", "dor", "pi")]
    out = []
    for _ in range(120):
        lines = [" ".join(rng.choices(words, k=rng.randint(3, 12))) for _ in range(rng.randint(1, 9))]
        kind = rng.random()
        if kind < 0.1:
            lines = [" ".join(w.upper() + "!!" for w in x.split()) for x in lines]
        elif kind < 0.2:
            lines = [" ".join(w + rng.choice(["***", "$$$", "%%%", "&&&"]) for w in x.split()) for x in lines]
        elif kind < 0.3:
            lines = lines * 3
        out.append("\n".join(lines))
    return [*out, None, "", " \n\t\r\x0b\x0c ", "one", "a a a a a a", "a b c d e a b c d e", "x\n\nx\n \nx", "    nbsp", "\U0001f600 <b> | #", *["same text again and again here"] * 5]


def brute_posterior(cast, good, right):
    odds = math.log(good / (1 - good))
    for v, (g, b) in zip(cast, right, strict=True):
        odds += math.log(g / (1 - b)) if v == 1 else math.log((1 - g) / b) if v == -1 else 0.0
    return 1 / (1 + math.exp(-odds))


def brute_estimate(patterns, rounds=rules.ROUNDS):
    good, right = rules.START_GOOD, [rules.START_RIGHT] * len(patterns[0][0])
    for _ in range(rounds):
        p = [brute_posterior(v, good, right) for v, _ in patterns]
        mean = lambda hits, of, first: (hits + rules.PRIOR_VOTES * first) / (of + rules.PRIOR_VOTES)
        found = []
        for k in range(len(right)):
            g = mean(sum(n * q for (v, n), q in zip(patterns, p, strict=True) if v[k] == 1), sum(n * q for (v, n), q in zip(patterns, p, strict=True) if v[k]), rules.START_RIGHT[0])
            b = mean(sum(n * (1 - q) for (v, n), q in zip(patterns, p, strict=True) if v[k] == -1), sum(n * (1 - q) for (v, n), q in zip(patterns, p, strict=True) if v[k]), rules.START_RIGHT[1])
            found.append((g, max(b, 1 - g)))
        good, right = mean(sum(n * q for (_, n), q in zip(patterns, p, strict=True)), sum(n for _, n in patterns), rules.START_GOOD), found
    return good, right


def test_counts_votes_estimates_and_verdicts_equal_brute_force(rows):
    docs = list(enumerate(texts()))
    out, trust = rules.judge(rows(docs, SCHEMA).repartition(5))
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(t), repr(t)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
    names = [f"vote_{r.name}" for r in rules.RULES]
    good, right = brute_estimate(sorted(Counter(tuple(r[n] for n in names) for r in got.values()).items()))
    assert abs(trust.good - good) < 1e-9
    for r in got.values():
        p = brute_posterior([r[n] for n in names], good, right)
        assert abs(r["posterior"] - p) < 1e-6 and r["kept"] == (not r["base_failed"] and p >= 0.5)
    assert all(b >= 1 - g for g, b in trust.right)


def test_votes_that_agree_outweigh_one_that_is_often_wrong(rows):
    # two rules that see the same defect, and one that votes at random
    three = (rules.Rule("a", "x = 1", "x = 0"), rules.Rule("b", "y = 1", "y = 0"), rules.Rule("noise", "z = 1", "z = 0"))
    rng = random.Random(0)
    data = [(int(i % 5 == 0), int(i % 5 == 0), rng.randint(0, 1)) for i in range(2000)]
    cast = rules.votes(three)
    patterns = rows(data, "x int, y int, z int").groupBy(*[v.alias(f"v{k}") for k, v in enumerate(cast)]).agg(F.count("*").alias("n"))
    trust = rules.estimate(patterns, 3)
    assert abs(trust.good - 0.8) < 0.01 and all(min(trust.right[k]) > 0.99 for k in (0, 1))
    assert abs(trust.right[2][0] - 0.5) < 0.05 and abs(trust.right[2][1] - 0.5) < 0.1


def test_odd_tables(rows):
    assert rules.judge(rows([], SCHEMA))[0].count() == 0
    long = " ".join(f"w{i}" for i in range(60_000)) + "\n" + "a" * 1_000_000 + "\n" + " ".join(["b c d e f"] * 5000)
    wide = rows([(1, long, 5, "x"), (None, None, 6, "y"), (1, long, 7, "z")], "doc_id long, text string, n_words int, words string")
    got = sorted((r["doc_id"] or 0, *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], r["kept"]) for r in rules.judge(wide)[0].collect())
    assert got[0] == (0, 0, 0, 0, 0, 0, False)
    assert got[1] == got[2] and got[1][:6] == (1, *brute_counts(long))


def test_held_out_grades(spark):
    """Rules never see labels; of sf0.01 they keep every good text that the base keeps and drop nearly all poor ones."""
    sf = "/root/testdata/sf0.01"
    out = catalog.QUERIES["op12_voting_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in out.where("NOT base_failed OR quality = 0").groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.005 * n[1, True] and n.get((0, True), 0) <= 0.05 * n[0, False]
