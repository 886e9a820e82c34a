"""Token sequences: padding, reading back, sentences, and documents made of sections."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

START, END, PAD = "<s>", "</s>", "<pad>"


def padded(words: Column, size: int) -> Column:
    """The words between START and END, cut and padded to `size` tokens; null has no words."""
    kept = F.slice(F.coalesce(words, F.array().cast("array<string>")), 1, size - 2)
    whole = F.concat(F.array(F.lit(START)), kept, F.array(F.lit(END)))
    return F.concat(whole, F.array_repeat(F.lit(PAD), F.lit(size) - F.size(whole)))


def until_end(tokens: Column) -> Column:
    """The words before the first END, without marks."""
    end = F.array_position(tokens, END)
    head = F.when(end > 0, F.slice(tokens, F.lit(1), (end - 1).cast("int"))).otherwise(tokens)
    return F.filter(head, lambda t: ~t.isin(START, PAD))


def sentences(tokens: Column) -> Column:
    """Runs of tokens, each up to and with its terminator; the rest is a sentence of its own."""
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("open"))

    def add(state: Column, t: Column) -> Column:
        now = F.concat(state["open"], F.array(t))
        over = t.isin(".", "!", "?", "।")
        return F.struct(F.when(over, F.concat(state["done"], F.array(now))).otherwise(state["done"]).alias("done"), F.when(over, empty).otherwise(now).alias("open"))

    return F.aggregate(tokens, start, add, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def section_text(sections: Column, key: Column, full: Column, most: int) -> Column:
    """The words of a section, or of the whole document where there is no such section; `most` at most."""
    found = F.try_element_at(sections, key.cast("string"))
    chosen = F.when(F.coalesce(found, F.lit("")) != "", found).otherwise(F.coalesce(full, F.lit("")))
    return F.slice(F.filter(F.split(chosen, r"\s+"), lambda w: w != ""), 1, most)


def _strings(value: object) -> str:
    if isinstance(value, str):
        return value
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return " ".join(t for t in map(_strings, inner) if t)


@F.pandas_udf(StringType())
def flat_text(raw: pd.Series) -> pd.Series:
    """All strings inside a JSON text, in order, joined by spaces; text that isn't JSON stays as it is."""

    def one(t: str | None) -> str | None:
        try:
            return _strings(json.loads(t)) if t is not None else None
        except ValueError:
            return t

    return raw.map(one, na_action="ignore")


@F.pandas_udf(StructType([StructField("full", StringType()), StructField("sections", MapType(StringType(), StringType()))]))
def document(raw: pd.Series) -> pd.DataFrame:
    """A JSON document's sections (keys of digits) and its full text: the sections in the order of their numbers, else all
    its parts. A plain text is section 0."""

    def one(t: str | None) -> tuple[str, dict]:
        if t is None:
            return "", {}
        try:
            value = json.loads(t)
        except ValueError:
            value = t
        if isinstance(value, str):
            return value, {"0": value}
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        parts = {str(k): x for k, v in items if (x := _strings(v))}
        sections = {k: v for k, v in parts.items() if k.isdigit()}
        return " ".join(sections[k] for k in sorted(sections, key=int)) if sections else " ".join(parts.values()), sections

    return pd.DataFrame([one(t) for t in raw], columns=["full", "sections"])


def gap_seconds(a: Column, b: Column) -> Column:
    """Seconds between two timestamps in text; null where one can't be read."""
    return F.abs(F.unix_timestamp(F.try_to_timestamp(a)) - F.unix_timestamp(F.try_to_timestamp(b)))


class FlatValues:
    """A table function: (place, path, value) of every string, number and boolean inside a JSON text, in order.

    Steps of a path are joined by dots, list places count from 0. Null and text that isn't JSON give no rows; an empty
    list or object gives none either. Depth is bounded by the JSON reader alone: the walk keeps a stack of its own.
    """

    def eval(self, raw: str):
        try:
            stack = [("", json.loads(raw))] if raw is not None else []
        except (ValueError, RecursionError):
            return
        place = 0
        while stack:
            path, value = stack.pop()
            if isinstance(value, (dict, list)):
                inner = list(value.items() if isinstance(value, dict) else enumerate(value))
                stack += [(f"{path}.{k}" if path else str(k), v) for k, v in reversed(inner)]
            elif value is not None:
                yield place, path, value if isinstance(value, str) else json.dumps(value)
                place += 1


def register(spark) -> None:
    """Makes flat_values(json) known to a session's SQL, for lateral joins."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("flat_values", udtf(FlatValues, returnType="place long, path string, value string"))
