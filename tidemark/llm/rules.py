"""Quality rules by weak supervision, in DataFrame expressions only.

Each rule looks at a text and votes good (1), bad (0) or abstains (null). Expectation-maximisation
over the counts of vote patterns estimates how accurate each rule is, without labels; a document is
kept when its posterior probability of being good is high enough. A document that fails the base
rules is out whatever the vote.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import GAP, stored, table

RULES = ("length", "symbols", "bare_words", "letters", "capitals", "exclaimed", "lines", "repeats", "variety", "word_size")


def _measured(docs: DataFrame) -> DataFrame:
    """Counts per document. Each step uses an array of the step before at least twice, so that Spark computes it once."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text"), F.array_remove(F.split(text, GAP), "").alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    d = d.select("*", F.transform("w", lambda w: F.xxhash64(w)).alias("x"))
    hashes = F.expr("CASE WHEN size(x) >= 5 THEN transform(sequence(0, size(x) - 5), i -> xxhash64(x[i], x[i+1], x[i+2], x[i+3], x[i+4])) ELSE array() END")
    d = d.select(
        "doc_id",
        "text_hash",
        "w",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace("text", "[^!]+", "")).cast("long").alias("n_exclaimed"),
        F.size(F.filter("w", lambda w: ~w.rlike(r"\p{L}"))).cast("long").alias("n_bare_words"),
        hashes.alias("h"),
    )
    kept = [c for c in d.columns if c not in ("w", "h")]
    # Equal windows have equal hashes: only texts with equal hashes need their windows compared.
    windows = F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN array_sort(transform(sequence(0, size(w) - 5), i -> struct(concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS s, i AS p))) ELSE array() END")
    d = d.select(*kept, windows.alias("s"))
    d = d.select(*kept, F.expr("zip_with(s, slice(s, 2, greatest(0, size(s) - 1)), (a, b) -> struct(a.p AS p, coalesce(a.s = b.s, false) AS same))").alias("e"))
    d = d.select(*kept, F.expr("array_sort(filter(zip_with(e, concat(array(struct(-1 AS p, false AS same)), slice(e, 1, greatest(0, size(e) - 1))), (a, b) -> IF(a.same OR b.same, a.p, NULL)), x -> x IS NOT NULL))").alias("p"))
    repeated = F.expr("aggregate(zip_with(p, slice(p, 2, greatest(0, size(p) - 1)), (a, b) -> least(5, coalesce(b - a, 5))), 0L, (t, x) -> t + x)")
    return d.select(*kept, repeated.alias("n_repeat_words"))


def _vote(bad: Column, good: Column | None = None) -> Column:
    return F.when(bad, 0) if good is None else F.when(bad, 0).when(good, 1)


def _voted(d: DataFrame) -> DataFrame:
    n = F.greatest("n_words", F.lit(1))
    mean = F.col("word_chars") / n
    a_word = {c: F.col(f"n_{c}") / n for c in ("symbols", "bare_words", "exclaimed", "repeat_words", "distinct")}
    lines = F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))
    capitals = F.col("n_capitals") / F.greatest("n_letters", F.lit(1))
    letters = F.col("n_letters") / F.greatest("word_chars", F.lit(1))
    enough = F.col("n_words") >= 35  # shares of few words say little
    votes = {
        "length": _vote(F.col("n_words") < 10),
        "symbols": _vote(a_word["symbols"] > 0.25, a_word["symbols"] < 0.05),
        "bare_words": _vote((a_word["bare_words"] > 0.2) & enough, a_word["bare_words"] < 0.1),
        "letters": _vote((letters < 0.75) & enough, letters > 0.9),
        "capitals": _vote(capitals > 0.4, capitals < 0.15),
        "exclaimed": _vote(a_word["exclaimed"] > 0.3, a_word["exclaimed"] < 0.1),
        "lines": _vote((lines > 0.3) & (F.col("n_dup_lines") > 2), lines < 0.1),
        "repeats": _vote(a_word["repeat_words"] > 0.2, a_word["repeat_words"] < 0.1),
        "variety": _vote((a_word["distinct"] < 0.1) & (F.col("n_words") >= 50)),
        "word_size": _vote((mean < 2) | (mean > 15)),
    }
    slots = [F.lit(3 * i) + F.when(v == 0, 1).when(v == 1, 2).otherwise(0) for i, v in enumerate(votes[k] for k in RULES)]
    return d.withColumn("votes", F.array(*slots, F.lit(PRIOR)))


#: A vote is the number 3 * rule + (0: abstains, 1: bad, 2: good); each pattern ends in one that stands for the prior.
PRIOR = 3 * len(RULES)
#: Before the first round, by true class (bad, good): how often a rule votes bad, and how often good.
START = ((0.3, 0.01), (0.6, 0.8))


def _posterior(weights: list[float]) -> Column:
    """Probability of good: log odds add up over the votes, with rules independent given the truth."""
    table_ = F.array(*(F.lit(float(w)) for w in weights))
    return 1 / (1 + F.exp(-F.aggregate("votes", F.lit(0.0), lambda total, at: total + F.element_at(table_, at + 1))))


def learned(voted: DataFrame, rounds: int = 25) -> list[float]:
    """The log odds of good that each vote adds, the prior's last; an abstention adds nothing.

    Expectation-maximisation from START over vote patterns (3 ** 10 at most, whatever the table), not documents: Spark counts
    them, and the driver goes over the counts. A bad vote stays at least twice as likely for a bad document, and a good vote no
    likelier, so that the classes keep their meaning; 20 pseudo-votes at START smooth the rates.
    """
    patterns = [(r["votes"], r["n"]) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()]

    def weights(rates: list[tuple[float, float]], prior: float) -> list[float]:
        return [0.0 if at % 3 == 0 else math.log(good / bad) for at, (bad, good) in enumerate(rates)] + [math.log(prior / (1 - prior))]

    rates = [(1.0, 1.0), *START] * len(RULES)
    now = weights(rates, 0.8)
    for _ in range(rounds if patterns else 0):
        sums = [[0.0, 0.0] for _ in now]
        for votes, n in patterns:
            q = 1 / (1 + math.exp(-sum(now[at] for at in votes)))
            for at in votes:
                sums[at][0] += n * (1 - q)
                sums[at][1] += n * q
        bad, good = sums[PRIOR]
        for at in range(PRIOR):
            if at % 3:
                b, g = ((n + 20 * s) / (of + 20) for n, s, of in zip(sums[at], START[at % 3 - 1], (bad, good), strict=True))
                rates[at] = (b, min(g, b / 2)) if at % 3 == 1 else (min(b, g), g)
        before, now = now, weights(rates, min(0.99, max(0.01, (good + 8) / (good + bad + 10))))
        if max(abs(x - y) for x, y in zip(before, now, strict=True)) < 1e-3:
            break
    return now


def judged(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """Counts, votes (see PRIOR), posterior, base_failed and kept for each row of docs (doc_id, text).

    Null and empty texts have no words, so they fail the base rules. Rows that repeat a doc_id are judged one by one.
    A null doc_id stays null. No rows: no rows. Very long texts are judged whole. Other columns are left out.
    """
    counts = stored(_voted(_measured(docs)), "rules")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = counts.withColumn("posterior", _posterior(learned(counts))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep))


def kept_documents(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """The rows of docs that judged() keeps, with all their columns. A verdict follows from the text alone, so rows with a null or
    repeated doc_id each have their own: they are named by doc_id and a 64-bit hash of the text."""
    verdict = judged(docs, keep).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(verdict, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left_semi")


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
