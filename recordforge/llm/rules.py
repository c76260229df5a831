"""Quality rules as weak supervision.

Each rule looks at counts of a text and votes "good" (1), "bad" (-1) or abstains (0). No rule decides alone: the accuracy of
every rule and the share of good texts are estimated by expectation-maximisation from how the rules agree over the whole
table, and a text is kept if the posterior probability that it is good is high enough. All counts and posteriors are
built-in functions; expectation-maximisation runs over the table of vote patterns, which has at most 3 ** (number of
rules) rows whatever the input.

NULL texts count like empty ones. Texts on which all rules abstain get the share of good texts as posterior. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordforge.llm.work import SPACES, free_name, stored

SYMBOLS = "#*$%&|<>"
_SEPARATORS = "[\\x20\\x09-\\x0D]+"
WINDOW = 8
FALSE_ALARMS = 0.01  # at most this share of good texts gets a bad vote from one rule
_NOT_LETTERS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())  # digits and all beyond ASCII pass as letters


def text_counts(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """Columns `keep` with the counts that the rules read, each of them a long named n_… or word_chars."""
    source = F.coalesce(F.col(text), F.lit(""))
    listed = docs.select(*keep, source.alias("_t"), F.array_remove(F.split(source, _SEPARATORS), "").alias("_w"))
    starts = F.when(F.size("_w") >= WINDOW, F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1))).otherwise(
        F.array().cast("array<int>")
    )
    hashed = listed.withColumn("_h", F.transform(starts, lambda i: F.xxhash64(F.slice("_w", i, WINDOW))))
    # Most texts repeat no window; only the others are searched for where.
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    placed = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = hashed.withColumn("_o", F.when(repeats, F.sort_array(placed)))
    near = lambda k: F.try_element_at("_o", k)["h"]
    twice = F.filter("_o", lambda x, k: (near(k + 2) == x["h"]) | ((k > 0) & (near(F.greatest(k, F.lit(1))) == x["h"])))
    at = F.array_sort(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )
    lines = F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))
    length = F.char_length("_t")
    without = lambda chars: F.char_length(F.translate("_t", chars, ""))
    counted = ordered.select(
        *keep,
        F.size("_w").alias("n_words"),
        without(SPACES).alias("word_chars"),
        (length - without(SYMBOLS)).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.when(F.col("_o").isNotNull(), covered).otherwise(F.lit(0)).alias("n_repeat_words"),
        F.size(lines).alias("n_lines"),
        F.size(F.array_distinct("_w")).alias("n_distinct_words"),
        (length - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_capitals"),
        (length - without("abcdefghijklmnopqrstuvwxyz")).alias("n_small"),
        (length - without("!?")).alias("n_calls"),
        without(_NOT_LETTERS).alias("n_letters"),
        F.rlike(F.rtrim(F.col("_t")), F.lit("[.!?…\"')\\]]$")).cast("int").alias("n_ends"),
    )
    return counted.select(*keep, *[F.col(c).cast("long").alias(c) for c in counted.columns[len(keep) :]])


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def default_rules() -> dict[str, Column]:
    """Votes over the columns of `text_counts`."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.col
    return {
        "length": _vote(n < 20, n >= 50),
        "repeats": _vote(c("n_repeat_words") * 100 > n * 30, c("n_repeat_words") * 100 <= n * 15),
        "symbols": _vote(c("n_symbols") * 100 > n * 10, c("n_symbols") * 100 <= n * 3),
        "lines": _vote(c("n_dup_lines") * 100 > c("n_lines") * 30, c("n_dup_lines") * 100 <= c("n_lines") * 10),
        "word_length": _vote((c("word_chars") < n * 2) | (c("word_chars") > n * 14), c("word_chars").between(n * 3, n * 10)),
        "capitals": _vote(c("n_capitals") > c("n_small"), c("n_capitals") * 3 < c("n_small")),
        "variety": _vote((n >= 50) & (c("n_distinct_words") * 100 < n * 20), c("n_distinct_words") * 100 >= n * 40),
        "calls": _vote(c("n_calls") * 100 > n * 30, c("n_calls") * 100 <= n * 10),
        "letters": _vote(c("n_letters") * 100 < c("word_chars") * 90, c("n_letters") * 100 >= c("word_chars") * 94),
        "ending": _vote(F.lit(False), c("n_ends") == 1),
    }


class Estimate(NamedTuple):
    """Share of good texts, and for every rule P(vote | good text) and P(vote | bad text) by vote -1, 0, 1."""

    prior: float
    good: list[dict[int, float]]
    bad: list[dict[int, float]]

    def weights(self) -> list[dict[int, float]]:
        """Log likelihood ratio of each vote of each rule; abstaining says nothing."""
        return [{v: 0.0 if v == 0 else math.log(g[v] / b[v]) for v in g} for g, b in zip(self.good, self.bad)]

    def posterior(self, votes: Sequence[int]) -> float:
        odds = math.log(self.prior / (1 - self.prior)) + sum(w[v] for w, v in zip(self.weights(), votes))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def estimate(patterns: Sequence[tuple[Sequence[int], int]], n_rules: int, rounds: int = 40) -> Estimate:
    """Expectation-maximisation over (votes, count).

    A rule has two accuracies: how often it is right when it votes on good texts and when it votes on bad ones. The start
    says that a bad vote is rare on good texts, and that a bad text is caught by a quarter of the rules.
    """
    total = sum(n for _, n in patterns)
    found = Estimate(0.85, [{-1: 0.01, 0: 0.1, 1: 0.89}] * n_rules, [{-1: 0.25, 0: 0.1, 1: 0.65}] * n_rules)
    for _ in range(rounds if total else 0):
        share = [(votes, n, found.posterior(votes)) for votes, n in patterns]
        good = sum(n * p for _, n, p in share)
        good_votes, bad_votes = [], []
        for r in range(n_rules):
            # Each class starts from a few votes at its first guess, so no probability becomes 0.
            g, b = {-1: 0.05, 0: 0.5, 1: 4.45}, {-1: 1.25, 0: 0.5, 1: 3.25}
            for votes, n, p in share:
                g[votes[r]] += n * p
                b[votes[r]] += n * (1 - p)
            # Bad texts come in kinds that share few rules. Without a bound on false alarms the commonest kind would be all
            # of the bad class, and the others would be explained as good texts on which some rules fail.
            gs, bs = sum(g.values()), sum(b.values())
            g, b = {v: x / gs for v, x in g.items()}, {v: x / bs for v, x in b.items()}
            good_votes.append({-1: min(g[-1], b[-1], FALSE_ALARMS), 0: g[0], 1: max(g[1], b[1])})
            bad_votes.append(b)
        found = Estimate(min(max(good / total, 0.01), 0.99), good_votes, bad_votes)
    return found


def judge(counts: DataFrame, rules: dict[str, Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """Add `quality_probability` and `good`. `counts` is read twice, so it should be a stored table."""
    rules = rules or default_rules()
    names = list(rules)
    code = sum(((v + 1) * 3**i for i, v in enumerate(rules.values())), F.lit(0))
    seen = counts.groupBy(code.cast("long").alias("code")).count().orderBy("code").collect()
    patterns = [([r["code"] // 3**i % 3 - 1 for i in range(len(names))], r["count"]) for r in seen]
    found = estimate(patterns, len(names))
    odds = F.lit(math.log(found.prior / (1 - found.prior)))
    for vote, w in zip(rules.values(), found.weights()):
        odds = odds + F.when(vote == -1, w[-1]).when(vote == 1, w[1]).otherwise(0.0)
    name = free_name(counts, "quality_probability")
    judged = counts.withColumn(name, 1 / (1 + F.exp(-odds)))
    return judged.withColumn(free_name(counts, "good"), F.col(name) >= threshold)


def rule_verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept, quality_probability) for (doc_id, text)."""
    counts = stored(text_counts(docs, ["doc_id"]), "rule-counts")
    judged = judge(counts)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "quality_probability",
    )
