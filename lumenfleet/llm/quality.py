"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A rule is a boolean expression over a document's features that is true where the document fails. The cascade estimates on a sample
what each rule costs (the characters that it reads) and how much it rejects, and asks the rules in order of rejection per cost; CASE WHEN stops at the first
that fails, so the order decides the work and never the verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MOST_REPEATED = 50, 50

#: name -> expression over with_features() columns and the text, true where the document fails.
RULES: dict[str, Callable[[Column], Column]] = {
    "symbols": lambda text: F.col("n_symbols") * 10 > F.col("n_words"),
    "repeated_lines": lambda text: F.col("n_dup_lines") * 2 > F.col("n_lines"),
    "word_length": lambda text: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
    "exclamations": lambda text: F.regexp_count(text, F.lit("!")) * 3 > F.col("n_words"),
    "capitals": lambda text: F.regexp_count(text, F.lit(r"\p{Lu}(?<!\p{L}\p{Lu})\p{Lu}++(?!\p{L})")) * 10 > 3 * F.col("n_words"),
    "letters": lambda text: 2 * F.regexp_count(text, F.lit(r"[^\p{L}\x20\x09-\x0D]")) > F.col("word_chars"),
}


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text (null: none)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.withColumn("q_plain", F.trim(F.regexp_replace(text, SPACE, " ")))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    # Every run of three words, from each word on.
    threes = F.regexp_extract_all("q_plain", F.lit(r"(?=([^ ]++ [^ ]++ [^ ]++))[^ ]++"), 1)
    step = plain.withColumn("q_lines", lines).withColumn("q_threes", threes)
    n = F.when(F.col("q_plain") == "", F.lit(0)).otherwise(F.regexp_count("q_plain", F.lit(" ")) + 1)
    step = (
        step.withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", (F.length("q_plain") - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_lines", F.size("q_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"))
        .drop("q_lines", "q_plain")
    )
    # Only where a run of three occurs again are the runs sorted; equal neighbours then give the positions.
    again = F.size("q_threes") > F.size(F.array_distinct("q_threes"))
    placed = F.sort_array(F.arrays_zip(F.col("q_threes").alias("t"), F.sequence(F.lit(1), F.size("q_threes")).alias("i")))
    step = step.withColumn("q_placed", F.when(again, placed)).drop("q_threes")
    twins = F.filter(F.arrays_zip(F.col("q_placed").alias("a"), F.slice("q_placed", F.lit(2), F.size("q_placed")).alias("b")), lambda p: p["a"]["t"] == p["b"]["t"])
    step = step.withColumn("q_twins", F.when(F.col("q_placed").isNotNull(), twins)).drop("q_placed")
    at = F.array_sort(F.array_distinct(F.concat(F.transform("q_twins", lambda p: p["a"]["i"]), F.transform("q_twins", lambda p: p["b"]["i"]))))
    step = step.withColumn("q_at", at).drop("q_twins")
    # Words under the windows: each window adds what the one before it doesn't cover.
    gaps = F.transform(F.arrays_zip(F.col("q_at").alias("a"), F.slice("q_at", F.lit(2), F.size("q_at")).alias("b")), lambda p: F.least(F.lit(3), F.coalesce(p["b"] - p["a"], F.lit(3))))
    words = F.aggregate(gaps, F.lit(0), lambda total, g: total + g)
    return step.withColumn("n_repeat_words", F.coalesce(F.when(F.col("q_at").isNotNull(), words), F.lit(0)).cast("long")).drop("q_at")


#: name -> what asking the rule of one document costs, in characters read; rules that aren't named read features alone.
COSTS: dict[str, Callable[[Column], Column]] = {name: lambda text: F.length(text) + 1 for name in ("exclamations", "capitals", "letters")}


def cascade_order(sample: DataFrame, rules: dict[str, Callable[[Column], Column]], text_col: str = "text") -> list[str]:
    """Rule names by rejection per cost on a sample, in one job; the same sample gives the same order. Ties go by name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if not rules:
        return []
    sums = [F.count_if(rule(text)).alias(f"failed_{name}") for name, rule in rules.items()]
    sums += [F.sum(COSTS[name](text) if name in COSTS else F.lit(1)).alias(f"cost_{name}") for name in rules]
    found = sample.agg(*sums).first()
    return sorted(rules, key=lambda name: (-found[f"failed_{name}"] / (found[f"cost_{name}"] or 1), name))


def quality_rules(docs: DataFrame, rules: dict[str, Callable[[Column], Column]] | None = None, order: list[str] | None = None, sample_rows: int = 500, text_col: str = "text") -> DataFrame:
    """docs with the features, base_failed, failed (the first rule that the document fails in the cascade's order, or null) and kept.

    The order comes from a sample of some sample_rows documents, drawn evenly from all; it never touches the verdict. Null and empty texts have no words and fail the base
    rules. Columns of docs that are named like the new ones are replaced; no rows are dropped or merged.
    """
    rules = RULES if rules is None else rules
    new = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "kept", "q_plain", "q_lines", "q_threes", "q_placed", "q_twins", "q_at"}
    docs = docs.drop(*new)
    if order is None:
        share = min(1.0, sample_rows / max(1, docs.count()))
        order = cascade_order(with_features(docs.select(text_col).sample(share, seed=7), text_col), rules, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    failed = F
    for name in order:
        failed = failed.when(rules[name](text), F.lit(name))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    asked = with_features(docs, text_col).withColumn("base_failed", base)
    failed = F.when(~F.col("base_failed"), failed) if rules else F.lit(None).cast("string")
    return asked.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("failed").isNull())


OP7_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
g AS (SELECT r, i, words[i:i + 2] AS t FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM g) WHERE n > 1),
k AS (SELECT r, count(DISTINCT j)::BIGINT AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h) GROUP BY r),
f AS (SELECT l.doc_id, text, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(k.n, 0)::BIGINT AS n_repeat_words FROM l LEFT JOIN k USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols * 10 > n_words OR n_dup_lines * 2 > n_lines
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR len(regexp_extract_all(text, '!')) * 3 > n_words
       OR len(list_filter(regexp_extract_all(text, '\p{L}+'), lambda x: regexp_full_match(x, '\p{Lu}{2,}'))) * 10 > 3 * n_words
       OR 2 * len(regexp_extract_all(text, '[^\p{L}\x20\x09-\x0D]')) > word_chars) AS kept
FROM f
"""
