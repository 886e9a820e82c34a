"""Text statistics as built-in Spark column expressions: no user functions, one pass over each row.

Words are the maximal runs of characters other than space, tab, line feed, vertical tab, form feed and carriage
return. Null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = """
the of and to in is that it for was on are as with be by this at from or an not which
der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch
de la le les et des en un une du que est pour dans qui par sur pas au plus
el los las por con para una su se del lo como más o y a
""".split()

REPEAT_WINDOW = 8


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII texts take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text, in order; an empty array for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def settled(value: Column) -> Column:
    """The same value, in a form that the optimiser computes once: it doesn't copy it into filters above."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def count_of(text: Column, characters: str) -> Column:
    """How many characters of the text are in the given ASCII set."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def free_name(columns: list[str], name: str) -> str:
    """The name, made longer until no column has it (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def kept_apart(df: DataFrame, keep: tuple[str, ...], taken: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
    """df and the names under which the columns `keep` come out: a column whose name an operator takes for a result or for
    itself (letters of either case) comes out under that name made longer by underscores."""
    own, names = df, []
    used = {t.lower() for t in taken}
    for c in keep:
        name = free_name([*own.columns, *taken], c) if c.lower() in used else c
        own = own.withColumn(name, F.col(f"`{c}`")) if name != c else own
        names.append(name)
    return own, tuple(names)


def with_words(df: DataFrame, text: str) -> DataFrame:
    """(__row, __text, __words): all columns of df as one struct, so that no name can clash, the text (never null) and
    its words."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")
    return df.select(row, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text")).withColumn("__words", words_of(F.col("__text")))


def unpacked(columns: list[str]) -> list[Column]:
    """Columns of the struct __row."""
    return [F.col("__row").getField(c).alias(c) for c in columns]


def stop_word_count(words: Column) -> Column:
    forms = sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})
    return F.size(F.filter(words, lambda w: w.isin(forms))).cast("long")


def with_line_counts(df: DataFrame) -> DataFrame:
    """Adds __n_lines (lines with a word) and __n_dup_lines (those equal to an earlier line); needs __text."""
    df = df.withColumn("__lines", F.filter(F.split(F.col("__text"), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    return df.withColumn("__n_lines", F.size("__lines").cast("long")).withColumn("__n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))


def with_repeat_words(df: DataFrame, window: int = REPEAT_WINDOW) -> DataFrame:
    """Adds __n_repeat_words: words inside windows of `window` words found twice or more in the text; needs __words.

    Windows are compared by 64-bit hashes within one text. Only texts with a repeated window sort them.
    """
    df = df.withColumn("__wh", F.transform("__words", lambda w: F.xxhash64(w)))
    df = df.withColumn(
        "__h",
        F.when(F.size("__wh") >= window, F.transform(F.sequence(F.lit(1), F.size("__wh") - (window - 1)), lambda i: F.xxhash64(F.slice(F.col("__wh"), i, window)))).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn(
        "__s",
        F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    s = F.col("__s")
    twice = F.transform(s, lambda e, i: F.when((i > 0) & (e.h == F.get(s, i - 1).h), e.i).when((i < F.size(s) - 1) & (e.h == F.get(s, i + 1).h), e.i))
    df = df.withColumn("__at", F.sort_array(F.filter(twice, lambda x: x.isNotNull())))
    covered = F.aggregate(
        "__at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc.n + p + window - F.greatest(p, acc.end)).alias("n"), (p + window).alias("end")),
        lambda acc: acc.n,
    )
    return df.withColumn("__n_repeat_words", F.when(F.size("__at") > 0, covered).otherwise(0).cast("long"))
