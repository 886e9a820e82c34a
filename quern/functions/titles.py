"""Normal forms and parts of product titles."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


def normalize(text: Column) -> Column:
    """NFKC, lower case, one space for each run of characters that are neither letters nor numbers; null is empty."""
    return F.trim(F.regexp_replace(F.lower(_nfkc(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+", " "))


def numbers(text: Column) -> Column:
    """The distinct number tokens: digits, with one decimal part."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)))


def char_grams(text: Column, n: int) -> Column:
    """All runs of n characters; none in shorter texts."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.substr(text, k, F.lit(n)))).otherwise(F.array().cast("array<string>"))
