"""Quality rules as a bitmask ledger, in DataFrame expressions only.

``quality_ledger`` evaluates every rule once for each text and stores the
measurements and one integer whose bit k says that rule k failed. Policies are
versioned masks over these bits: ``apply_policy`` needs no text, and
``ablations`` counts, from the distinct bit patterns (at most two to the number
of rules), what each policy rejects with and without each of its rules.

Words are runs of characters other than space and U+0009 to U+000D. Null and
empty texts have no words and fail the word-count rule; other rules that divide
by words or lines hold for them. Repeated rows are judged one by one; columns
that clash with the measurements' names are replaced.

Work for one text is O(n log n) in its words, in one row: nothing is exploded
and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.rows import boxed, own, quoted, unboxed

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """``failed`` is a predicate over the measurements, never null."""

    name: str
    failed: Callable[[], Column]


def _over(part: str, percent: int, whole: str) -> Callable[[], Column]:
    return lambda: F.col(part) * 100 > F.col(whole) * percent


#: The place of a rule is its bit; rules are only ever added at the end.
RULES = [
    Rule("few_words", lambda: F.col("n_words") < 50),
    Rule("repeated_words", _over("n_repeat_words", 50, "n_words")),
    Rule("symbols", _over("n_symbols", 25, "n_words")),
    Rule("repeated_lines", _over("n_dup_lines", 40, "n_lines")),
    Rule("upper_case", _over("n_upper", 40, "word_chars")),
    Rule("long_words", lambda: F.col("word_chars") > F.col("n_words") * 200),
]
BIT = {r.name: 1 << k for k, r in enumerate(RULES)}
#: Versioned policies; a version never changes once published.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": BIT["few_words"] | BIT["repeated_words"] | BIT["symbols"] | BIT["repeated_lines"] | BIT["upper_case"],
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though the body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(inner) > 0, F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_words(w: Column) -> Column:
    """Words inside windows of three words that the text holds twice or more."""

    def hashes(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.size(w) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WINDOW))))

    def places(s: Column) -> Column:  # s: (hash, place), sorted; equal hashes are neighbours
        same = F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k + 1)["h"]) | (x["h"] == F.get(s, k - 1)["h"]), x["i"]))
        return F.sort_array(F.filter(same, lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))

    def total(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, lambda s: let(places(s), covered)))

    return F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes(w), total))


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the measurements (all long) of each text."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    of_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    first = boxed(
        df,
        of_words.alias("_w"),
        of_lines.alias("_l"),
        (F.length(text) - count_chars(text, SPACES)).cast("long").alias("word_chars"),
        count_chars(text, SYMBOLS).alias("n_symbols"),
        count_chars(text, UPPER).alias("n_upper"),
        but=MEASURES,
    )
    fields = {"n_words": F.col("_w.n"), "n_dup_lines": F.col("_l.d"), "n_repeat_words": F.col("_w.r"), "n_lines": F.col("_l.n")}
    return first.select(*own(df, *MEASURES), *(fields.get(m, F.col(m)).alias(m) for m in MEASURES))


def quality_ledger(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the measurements and fail_bits (long: room for 63 rules)."""
    measured = measure(df, text_col)
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.coalesce(rule.failed(), F.lit(False)), F.lit(BIT[rule.name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def apply_policy(ledger: DataFrame, policy: str = "v1", column: str = "kept") -> DataFrame:
    """The ledger with a boolean: no rule of the policy failed."""
    return ledger.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0)


def ablations(ledger: DataFrame) -> DataFrame:
    """For each policy and rule of it: documents rejected, by it alone, and without it."""
    patterns = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask).cast("long").alias("mask"), F.lit(BIT[r]).cast("long").alias("bit")) for p, mask in POLICIES.items() for r in BIT if mask & BIT[r]]
    each = patterns.select("fail_bits", "n", F.explode(F.array(*cases)).alias("c")).select("fail_bits", "n", "c.*")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy("policy", "rule").agg(
        total(hit != 0).alias("rejected"),
        total(hit.bitwiseAND(F.col("bit")) != 0).alias("failed_rule"),
        total(hit == F.col("bit")).alias("by_rule_alone"),
        total(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) != 0).alias("rejected_without"),
    )


def keep_good(df: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the policy keeps, with ``df``'s columns only."""
    return unboxed(apply_policy(quality_ledger(boxed(df, F.col(quoted(text_col)).alias("text"))), policy).where("kept"))
