"""Operator 1: quality by weak supervision, in DataFrame functions only.

Rules look at counts of a document and vote good (1), bad (-1) or abstain (0).
How often a rule is right isn't known: expectation-maximisation estimates it
together with the share of good documents, from how the rules agree over all
documents. The votes make at most 3**rules patterns, so the documents are
aggregated to patterns once and the iterations run on that bounded table. A
document's verdict is its posterior probability of being good.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

_WS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
ITERATIONS = 25
#: name, good if, bad if (over the features below).
RULES: list[tuple[str, str, str]] = [
    ("length", "n_words >= 50", "n_words < 20"),
    ("repetition", "n_words >= 50 AND n_repeat_words = 0", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "50 * n_symbols <= n_words AND n_words > 0", "10 * n_symbols > n_words"),
    ("lines", "n_lines >= 2 AND n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words AND n_words > 0", "2 * word_chars < 5 * n_words OR word_chars > 14 * n_words"),
    ("capitals", "10 * n_capitals <= 2 * word_chars AND word_chars > 0", "10 * n_capitals > 5 * word_chars"),
]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at (a null text has none of anything)."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    trimmed = F.regexp_replace("text", rf"^{_WS}+|{_WS}+$", "")
    d = d.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"{_WS}+")))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    capitals = "".join(map(chr, range(65, 91)))
    gone = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    d = d.select(
        "doc_id",
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - F.length(F.regexp_replace("text", _WS, ""))).alias("n_space"),
        F.length("text").alias("n_chars"),
        gone(SYMBOLS).cast("long").alias("n_symbols"),
        gone(capitals).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    d = d.withColumn("word_chars", (F.col("n_chars") - F.col("n_space")).cast("long"))
    # A hash of each window of words; h is named several times, so that it stays a column of its own.
    h = F.col("h")
    window = lambda x, i: F.xxhash64(x, *(h[i + k] for k in range(1, WINDOW)))
    d = d.withColumn("w", F.when(F.size("h") >= WINDOW, F.transform(F.slice("h", 1, F.size("h") - (WINDOW - 1)), window)).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("w")) < F.size("w")
    # The rest is done for documents with a repeated window only: sort windows by
    # hash and place, keep those with an equal neighbour, add up what they cover.
    d = d.withColumn("s", F.when(again, F.array_sort(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = F.col("s")
    twin = lambda v, i: ((i > 0) & (F.get(s, i - 1)["x"] == v["x"])) | F.coalesce(F.get(s, i + 1)["x"] == v["x"], F.lit(False))
    d = d.withColumn("p", F.array_sort(F.transform(F.filter(s, twin), lambda v: v["i"])))
    p, n = F.col("p"), F.size("p")
    covered = F.aggregate(F.zip_with(F.slice(p, 2, n - 1), F.slice(p, 1, n - 1), lambda b, a: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW).cast("long"), lambda t, x: t + x)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(F.when(n > 0, covered), F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", "n_capitals")


def _vote(good: str, bad: str) -> Column:
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int) -> tuple[float, list[float]]:
    """Share of good documents and each rule's accuracy where it votes, from vote patterns and their counts."""
    prior, right = 0.5, [0.8] * n_rules
    total = sum(n for _, n in patterns)
    for _ in range(ITERATIONS if total else 0):
        good, hits, votes = 0.0, [0.0] * n_rules, [0] * n_rules
        for pattern, n in patterns:
            p = posterior(pattern, prior, right)
            good += n * p
            for j, v in enumerate(pattern):
                if v:
                    hits[j] += n * (p if v > 0 else 1 - p)
                    votes[j] += n
        prior = min(0.99, max(0.01, good / total))
        right = [min(0.99, max(0.55, h / v)) if v else 0.8 for h, v in zip(hits, votes, strict=True)]
    return prior, right


def posterior(pattern: tuple[int, ...], prior: float, right: list[float]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(pattern, right, strict=True))
    return 1 / (1 + math.exp(-odds))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Per row of ``docs``: doc_id, counts, base_failed, votes, posterior and kept.

    kept is false where the base rule fails or the posterior is below ``least``.
    A null or empty text has counts of 0 and fails the base rule; a null doc_id
    is kept as it is; repeated rows count each; an empty table gives no rows;
    only doc_id and text are read.
    """
    rows = features(docs)
    rows = rows.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    rows = rows.withColumn("votes", F.array(*(_vote(good, bad) for _, good, bad in RULES)))
    rows, _ = written(rows, "quality")
    found = rows.groupBy("votes").count().collect()  # 3 ** len(RULES) rows at most
    prior, right = estimate(sorted((tuple(r["votes"]), r["count"]) for r in found), len(RULES))
    odds = F.lit(math.log(prior / (1 - prior)))
    for j, a in enumerate(right):
        odds = odds + F.col("votes")[j] * F.lit(math.log(a / (1 - a)))
    rows = rows.withColumn("posterior", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))
