"""Quality rules: a threshold table compiled into one Spark projection.

Every rule bounds one ratio of lengths, symbols, stop words or lines. The table is data; `compile_rules` turns it into
a single boolean expression, evaluated by Spark without user functions.

Defined results: null or blank text has no words and fails the base check; ratios over nothing are 0; repeated rows are
judged one by one; an empty table gives no rows; other columns never matter, since the output names its own columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import text_stats as ts


@dataclass(frozen=True)
class Rule:
    """The ratio `measure` must lie in [least, most]."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: measure -> (numerator, denominator, factor)
MEASURES = {
    "mean_word_length": ("word_chars", "n_words", 1.0),
    "symbol_ratio": ("n_symbols", "word_chars", 1.0),
    "exclamation_ratio": ("n_exclamations", "n_words", 1.0),
    "stop_word_ratio": ("n_stop_words", "n_words", 1.0),
    "duplicate_line_ratio": ("n_dup_lines", "n_lines", 1.0),
    "repeat_word_ratio": ("n_repeat_words", "n_words", 1.0),
}

#: The production table. Repetition and shortness are already in the base check.
RULES = (
    Rule("word_length", "mean_word_length", least=2.0, most=15.0),
    Rule("symbols", "symbol_ratio", most=0.05),
    Rule("shouting", "exclamation_ratio", most=0.35),
    Rule("function_words", "stop_word_ratio", least=0.03),
    Rule("line_repeats", "duplicate_line_ratio", most=0.50),
)
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def ratio(measure: str) -> Column:
    top, bottom, factor = MEASURES[measure]
    below = F.col(f"__{bottom}").cast("double")
    return F.when(below > 0, F.col(f"__{top}").cast("double") * factor / below).otherwise(0.0)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule of the table holds."""
    parts = []
    for r in rules:
        value = ratio(r.measure)
        if r.least is not None:
            parts.append(value >= F.lit(float(r.least)))
        if r.most is not None:
            parts.append(value <= F.lit(float(r.most)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "verdict") -> DataFrame:
    """df plus the struct column `out`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words,
    base_failed and kept. A column of df named `out` is replaced."""
    own = [c for c in df.columns if c != out]
    staged = ts.with_repeat_words(ts.with_line_counts(ts.with_words(df, text)))
    staged = (
        staged.withColumn("__n_words", F.size("__words").cast("long"))
        .withColumn("__word_chars", F.length(F.translate("__text", ts.BLANKS, "")).cast("long"))
        .withColumn("__n_symbols", ts.count_of(F.col("__text"), ts.SYMBOLS).cast("long"))
        .withColumn("__n_exclamations", ts.count_of(F.col("__text"), "!").cast("long"))
        .withColumn("__n_stop_words", ts.stop_word_count(F.col("__words")))
    )
    failed = (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__n_words"))
    fields = [F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words")]
    verdict = ts.settled(F.struct(*fields, failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept")))
    return staged.select(*ts.unpacked(own), verdict.alias(out))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that the table keeps, with the columns of df."""
    name = ts.free_name(df.columns, "__verdict")
    return judge(df, text, rules, name).where(F.col(name).getField("kept")).drop(name)
