"""Op 2. Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Votes are counted by pattern (at most 3^rules
rows, whatever the corpus), expectation-maximisation over those counts estimates each rule's
accuracy for either class and the class prior, and a document's posterior probability of being good
replaces all-must-pass filtering. Documents that fail the base rule are never kept and take no part
in the fit: the rules are there to judge the others.

Null and empty texts have no words, so they fail the base rule; very long texts are read whole;
repeated rows are rows of their own; null doc_ids pass through; an empty table gives no rows (the
prior is used unfitted); other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import BLANKS, stage, table

def features(docs: DataFrame) -> DataFrame:
    """Counts per document; a word-window repeat is found by sorting window hashes inside the row: no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.array_remove(F.split("text", BLANKS), "").alias("w"), F.split("text", "\n").alias("lines")
    )
    base = base.select(
        "doc_id",
        "text",
        "w",
        F.expr(r"filter(lines, x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        # as many low bits as the text's positions need
        F.expr("shiftleft(1L, length(bin(size(w)))) - 1").alias("low"),
    )
    base = base.select(
        "*",
        # hash and position in one long: sorting primitives is fast, and equal windows become neighbours
        F.expr("""sort_array(case when size(w) > 2 then transform(sequence(0, size(w) - 3),
            i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & ~low) | i) else array() end)""").alias("keys"),
    )
    near = """filter(sequence(0, size(keys) - 1), i ->
        (i > 0 and (keys[i] | low) = (keys[i - 1] | low)) or (i < size(keys) - 1 and (keys[i] | low) = (keys[i + 1] | low)))"""
    base = base.withColumn(
        # full windows, for the few positions whose short hashes agree
        "likely",
        F.expr(f"""case when size(keys) > 1 then array_sort(transform(transform({near}, j -> cast(keys[j] & low as int)),
            i -> struct(w[i] as a, w[i + 1] as b, w[i + 2] as c, i as i))) else array() end"""),
    )
    same = lambda d: f"likely[k].a = likely[k {d}].a and likely[k].b = likely[k {d}].b and likely[k].c = likely[k {d}].c"
    base = base.withColumn(
        "repeated",
        F.expr(f"""case when size(likely) > 1 then transform(filter(sequence(0, size(likely) - 1), k ->
            (k > 0 and {same("- 1")}) or (k < size(likely) - 1 and {same("+ 1")})), k -> likely[k].i) else array() end"""),
    )
    return base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.expr("aggregate(w, 0L, (n, x) -> n + length(x))").alias("word_chars"),
        F.expr("cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '')) as long)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr("cast(size(array_distinct(flatten(transform(repeated, i -> array(i, i + 1, i + 2))))) as long)").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr("cast(length(text) - length(regexp_replace(text, '[A-Z]', '')) as long)").alias("n_capitals"),
        F.expr("cast(length(text) - length(regexp_replace(text, '[.!?]', '')) as long)").alias("n_stops"),
        F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
    )


#: rule -> (expression for a bad vote, expression for a good vote); neither: abstain.
RULES = {
    "symbols_per_word": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "symbol_share": ("20 * n_symbols > word_chars", "500 * n_symbols <= word_chars"),
    "letters": ("100 * n_letters < 80 * word_chars", "100 * n_letters >= 92 * word_chars"),
    "word_length": ("2 * word_chars not between 5 * n_words and 17 * n_words", "2 * word_chars between 8 * n_words and 13 * n_words"),
    "line_repeats": ("10 * n_dup_lines > 2 * n_lines", "20 * n_dup_lines <= n_lines"),
    "word_repeats": ("100 * n_repeat_words > 25 * n_words", "100 * n_repeat_words <= 15 * n_words"),
    "capitals": ("100 * n_capitals > 30 * n_letters", "100 * n_capitals <= 10 * n_letters"),
    "stops": ("10 * n_stops > 5 * n_words or n_words > 150 * (n_stops + 1)", "n_stops * 3 <= n_words and n_words <= 60 * (n_stops + 1)"),
}


def votes(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {f"v_{r}": F.expr(f"case when n_words = 0 then -1 when {bad} then -1 when {good} then 1 else 0 end") for r, (bad, good) in RULES.items()}
    )


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int, steps: int = 60, trust: float = 0.05) -> tuple[float, list[dict[int, list[float]]]]:
    """EM over counted vote patterns: (prior of good, per rule {vote: [P(vote | bad), P(vote | good)]}).

    Starts from rules that are right more often than not; these starting beliefs also count as
    ``trust`` times the corpus in every step (plus one row), so no probability reaches 0 and the
    classes can't swap.
    """
    start = {-1: [0.6, 0.02], 0: [0.2, 0.18], 1: [0.2, 0.8]}
    prior, given = 0.9, [{v: list(p) for v, p in start.items()} for _ in range(rules)]
    weight = 1 + trust * sum(n for _, n in patterns)
    for _ in range(steps if patterns else 0):
        mass, seen = [0.1 * weight, 0.9 * weight], [{v: [weight * x for x in p] for v, p in start.items()} for _ in range(rules)]
        for pattern, n in patterns:
            good = posterior(prior, given, pattern)
            mass[0] += n * (1 - good)
            mass[1] += n * good
            for r, v in enumerate(pattern):
                seen[r][v][0] += n * (1 - good)
                seen[r][v][1] += n * good
        prior = mass[1] / sum(mass)
        totals = [[sum(s[v][c] for v in s) for c in (0, 1)] for s in seen]
        given = [{v: [s[v][c] / t[c] for c in (0, 1)] for v in s} for s, t in zip(seen, totals, strict=True)]
    return prior, given


def posterior(prior: float, given: list[dict[int, list[float]]], pattern: tuple[int, ...]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(g[v][1] / g[v][0]) for g, v in zip(given, pattern, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs(doc_id, text) -> counts, votes, base_failed, p_good and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stage(votes(features(docs)).withColumn("base_failed", failed), "votes")
    names = [f"v_{r}" for r in RULES]
    counted = [(tuple(x[:-1]), x[-1]) for x in rows.where(~F.col("base_failed")).groupBy(*names).count().collect()]  # 3^rules rows at most
    prior, given = fit(sorted(counted), len(names))
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, g in zip(names, given, strict=True):
        weight = {v: F.lit(math.log(p[1] / p[0])) for v, p in g.items()}
        odds = odds + F.when(F.col(name) == 1, weight[1]).when(F.col(name) == -1, weight[-1]).otherwise(weight[0])
    return rows.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )
