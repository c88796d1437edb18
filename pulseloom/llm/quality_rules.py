"""Quality rules as weak supervision, in DataFrame functions: rules vote or abstain, EM weighs them.

Each rule votes +1 (good), -1 (bad) or 0 (abstains). Expectation-maximisation over the counts of vote patterns of
all documents estimates for each rule how often it votes either way on good and on bad documents; the posterior
probability of being good decides on those that the base rules leave open.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import written

#: White space and symbols of the base measures (fixed values).
_WS, _SYMBOLS = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
#: Rules: name, condition of a vote for good, condition of a vote for bad (else the rule abstains).
RULES = (
    ("length", "n_words >= 50 and n_words <= 100000", "n_words < 20"),
    ("word_length", "word_chars >= 3 * n_words and word_chars <= 10 * n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("symbols", "20 * n_symbols <= n_words", "5 * n_symbols >= n_words"),
    ("dup_lines", "n_dup_lines = 0", "10 * n_dup_lines >= 3 * n_lines"),
    ("repeats", "20 * n_repeat_words <= n_words", "5 * n_repeat_words >= n_words"),
    ("upper", "50 * n_upper <= 10 * word_chars", "50 * n_upper >= 20 * word_chars"),
    ("ends", "10 * n_ends >= n_lines", "n_ends = 0"),
    ("plain", "10 * n_plain >= 8 * n_words", "10 * n_plain < 6 * n_words"),
)
#: EM: rounds at most, change of the log-likelihood per row at which it ends, pseudo-counts.
ROUNDS, TOLERANCE, PRIOR = 200, 1e-10, 1.0
#: Share of votes for good at the start, on good and on bad documents.
START_GOOD, START_BAD = 0.99, 0.6


def _once(value: Column, use) -> Column:
    """use(value) with value worked out once for each row."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of three words that are found twice or more (each word counts once)."""
    grams = lambda w: F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), F.xxhash64(w[i + 2], w[i], w[i + 1]).alias("g"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda x, y: (x["h"] == y["h"]) & (x["g"] == y["g"])
        n = F.size(s)
        hit = F.filter(s, lambda x, j: ((j > 0) & same(x, s[F.greatest(j - 1, F.lit(0))])) | ((j < n - 1) & same(x, s[F.least(j + 1, n - 1)])))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        n = F.size(p)
        return F.aggregate(F.transform(p, lambda x, j: F.when(j < n - 1, F.least(F.lit(3), p[F.least(j + 1, n - 1)] - x)).otherwise(3)), F.lit(0), lambda a, b: a + b)

    counted = _once(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(_once(_once(grams(w), twice), covered)))
    return counted.cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_ends, n_plain) of whole texts."""
    text = F.coalesce(F.col("_t"), F.lit(""))
    words = F.filter(F.split(text, _WS + "+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = _once(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("d"), F.size(x).alias("n")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_t"))
    found = _once(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    return rows.select(
        "doc_id",
        found.alias("_w"),
        (F.length(text) - F.regexp_count(text, F.lit(_WS))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        dup.alias("_d"),
        F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[.!?][\x20\x09-\x0D]*(?:\n|\z)")).cast("long").alias("n_ends"),
        F.regexp_count(text, F.lit(r"(?<!\S)\p{L}++[.,;:!?]?(?!\S)")).cast("long").alias("n_plain"),
    ).select("doc_id", F.col("_w.n").cast("long").alias("n_words"), "word_chars", "n_symbols", F.col("_d.d").cast("long").alias("n_dup_lines"), F.col("_w.r").alias("n_repeat_words"), F.col("_d.n").cast("long").alias("n_lines"), "n_upper", "n_ends", "n_plain")


def _vote(good: str, bad: str) -> Column:
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


def fit(patterns: dict[tuple[int, ...], int], rules: int) -> tuple[float, list[dict[int, float]]]:
    """EM over counts of vote patterns (at most 3**rules): the log-odds of good a priori, and for each rule the log-ratio of each vote.

    A rule that abstains says nothing. One that votes says "good" with its own probability on good and on bad
    documents; at the start a vote for bad is rare on good documents and frequent on bad ones.
    """
    share, on_good, on_bad = 0.8, [START_GOOD] * rules, [START_BAD] * rules
    total, last = sum(patterns.values()), -math.inf
    for _ in range(ROUNDS if total else 0):
        sums = [[[PRIOR, PRIOR] for _ in range(rules)] for _ in range(2)]
        mass, seen = 0.0, 0.0
        for votes, n in sorted(patterns.items()):
            a = math.log(share) + sum(math.log(on_good[j] if v > 0 else 1 - on_good[j]) for j, v in enumerate(votes) if v)
            b = math.log(1 - share) + sum(math.log(on_bad[j] if v > 0 else 1 - on_bad[j]) for j, v in enumerate(votes) if v)
            top = max(a, b)
            whole = top + math.log(math.exp(a - top) + math.exp(b - top))
            seen += n * whole
            p = math.exp(a - whole)
            mass += n * p
            for j, v in enumerate(votes):
                if v:
                    sums[0][j][v < 0] += n * p
                    sums[1][j][v < 0] += n * (1 - p)
        share = (mass + PRIOR) / (total + 2 * PRIOR)
        for good, bad in zip(*sums):  # a rule is no worse than chance: else its votes say nothing
            if good[0] * bad[1] < bad[0] * good[1]:
                good[:] = bad[:] = [good[0] + bad[0], good[1] + bad[1]]
        on_good, on_bad = ([x / (x + y) for x, y in side] for side in sums)
        if seen - last < TOLERANCE * total:
            break
        last = seen
    return math.log(share / (1 - share)), [{1: math.log(g / b), 0: 0.0, -1: math.log((1 - g) / (1 - b))} for g, b in zip(on_good, on_bad)]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior) of each row.

    base_failed: fewer than 50 words, or more than half of them in repeated three-word windows. kept: not failed and
    the posterior probability of good at least ``threshold``.

    Null and empty texts have no words and fail. Repeated rows and null ids each give a row, other columns are
    not read, an empty table gives an empty result.
    """
    rows = measures(docs, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = written(rows.withColumns({f"v_{name}": _vote(good, bad) for name, good, bad in RULES}).withColumn("base_failed", failed), "votes")
    names = [f"v_{r[0]}" for r in RULES]
    patterns = {tuple(r[n] for n in names): r["n"] for r in rows.groupBy(*names).agg(F.count("*").alias("n")).collect()}
    prior, ratios = fit(patterns, len(RULES))
    odds = F.lit(prior)
    for name, ratio in zip(names, ratios):
        odds = odds + F.when(F.col(name) == 1, ratio[1]).when(F.col(name) == -1, ratio[-1]).otherwise(ratio[0])
    posterior = 1 / (1 + F.exp(-odds))
    out = rows.withColumn("posterior", posterior)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "posterior")
