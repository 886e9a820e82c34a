"""Normalising, tokenising and classing the words of chat text in English, French, Hindi and romanised Hindi."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns and word lists.
LETTERS = "a-z0-9À-ÖØ-öø-ɏ"
DEVANAGARI = "ऀ-ॣ०-ॿ"
TOKEN = rf"[{DEVANAGARI}]+|(?:qu|jusqu|lorsqu|puisqu|[ldjmtsnc])'(?=[{LETTERS}])|[{LETTERS}]+(?:'[{LETTERS}]+)?|<[a-z0-9_]+>|\S"
URL = r"https?://\S+|www\.\S+"
STOP_WORDS = """the a an of and or to in on at is are was were be been it its this that these those for with as by from
he she they we you i me my your his her their our not no yes so but if then than too very can will just
hai hain tha thi the ho hoga hogi to ki ke ka ko se me mein par aur ya nahi nahin haan kya ye yeh wo woh
bhi hi ek is us un in kuch bahut mujhe tumhe aap main tum hum
है हैं था थी थे हो होगा होगी की के का को से में पर और या नहीं हाँ हां क्या ये यह वो वह भी ही एक इस उस कुछ बहुत मुझे तुम्हें आप मैं तुम हम वे तो कि थीं हूँ हूं लिए साथ कर रहा रही रहे जा""".split()
CLOSING = list(".,!?;:%)]}।॥")
OPENING = list("([{$")


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


def normalize(text: Column) -> Column:
    """NFC, straight quotes, no zero-width joiners beside Devanagari, lower case, <url>, at most two equal letters in a row,
    single spaces; null is empty."""
    t = F.translate(_nfc(F.coalesce(text, F.lit(""))), "‘’", "''")
    t = F.regexp_replace(t, "(?<=[ऀ-ॿ])[‌‍]|[‌‍](?=[ऀ-ॿ])", "")
    t = F.regexp_replace(F.lower(t), URL, " <url> ")
    t = F.regexp_replace(t, r"([a-z])\1{2,}", "$1$1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(normalize(text), F.lit(TOKEN), F.lit(0))


def script(token: Column) -> Column:
    """dev, lat (letters and digits of other scripts too) or other, by the first character."""
    return F.when(token.rlike(f"^[{DEVANAGARI}]"), "dev").when(token.rlike(r"^[\p{L}\p{N}]"), "lat").otherwise("other")


def word_like(token: Column) -> Column:
    """Whether a token is a word: Devanagari, or letters only and more than one of them."""
    return F.coalesce((script(token) == "dev") | ((F.length(token) > 1) & token.rlike(r"^\p{L}+$")), F.lit(False))


def content_words(tokens: Column, least: int = 4, least_devanagari: int = 3) -> Column:
    """Words that aren't stop words: of Devanagari with least_devanagari code points, else of letters only with least."""

    def keep(t: Column) -> Column:
        long_enough = F.when(script(t) == "dev", (F.length(t) >= least_devanagari) & ~t.rlike(r"^\p{Nd}+$")).otherwise((F.length(t) >= least) & t.rlike(r"^\p{L}+$"))
        return long_enough & ~t.isin(STOP_WORDS)

    return F.filter(tokens, keep)


def detokenize(tokens: Column) -> Column:
    """Tokens joined by spaces, but none before closing marks and none after opening marks and apostrophes."""

    def add(text: Column, t: Column) -> Column:
        tight = t.isin(CLOSING) | F.right(text, F.lit(1)).isin([*OPENING, "'"])
        return F.when(text == "", t).when(tight, F.concat(text, t)).otherwise(F.concat(text, F.lit(" "), t))

    return F.aggregate(tokens, F.lit(""), add)


def overlap_share(reply: Column, source: Column) -> Column:
    """Share of the reply's content words (repeats count) that occur in the source's tokens; null without content words."""
    words = content_words(reply)
    return F.try_divide(F.size(F.filter(words, lambda t: F.array_contains(source, t))).cast("double"), F.size(words))


def english_share(mixed: Column, english: Column) -> Column:
    """Share of a turn's words that its English version has too; Devanagari words count below only; null without words."""
    words = F.filter(mixed, word_like)
    return F.try_divide(F.size(F.filter(words, lambda t: (script(t) == "lat") & F.array_contains(english, t))).cast("double"), F.size(words))


def mix_bucket(share: Column) -> Column:
    return F.when(share.isNull(), "unknown").when(share >= 0.6, "mostly English").when(share >= 0.3, "mixed").otherwise("mostly Hindi")
