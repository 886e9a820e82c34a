"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import dialect, dialogue, generation, learning, ordered, pairs, portable, products, recommend, shaped
from quern.session import ensure_checkpoint_dir
from quern.sources.tables import table


VIEWS = {**portable.VIEWS, **recommend.VIEWS, **products.VIEWS, **dialogue.VIEWS}
STAGED = {*products.STAGED, *dialogue.STAGED}
#: Views that Spark computes once, and its forms of views; the SQL for DuckDB knows nothing of these.
SPARK_STAGED = STAGED | {*recommend.SPARK_STAGED, *products.SPARK_VIEWS}
SPARK_VIEWS = {**products.SPARK_VIEWS, **recommend.SPARK_VIEWS}


def _names(sql: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", sql))


def expand(sql: str, staged: set[str] = STAGED) -> str:
    """SQL in which {view} is written out; {table} and the views that are computed once are left."""
    while views := (_names(sql) & VIEWS.keys()) - staged:
        for v in views:
            sql = sql.replace(f"{{{v}}}", f"({VIEWS[v]})")
    return sql


def in_spark(sql: str) -> Callable[..., DataFrame]:
    full = expand(sql, SPARK_STAGED)
    text, names = dialect.spelled(full, dialect.SPARK), sorted(_names(full))

    def run(spark: SparkSession, sf_dir: str, staged: dict[str, DataFrame] | None = None, **own: DataFrame) -> DataFrame:
        staged = {} if staged is None else staged

        def source(name: str) -> DataFrame:
            if name in own:
                return own[name]
            if name not in SPARK_STAGED:
                return table(spark, sf_dir, name)
            if name not in staged:
                ensure_checkpoint_dir(spark)
                made = SPARK_VIEWS.get(name)
                rows = made(lambda sql, **own: in_spark(sql)(spark, sf_dir, staged, **own)) if made else in_spark(VIEWS[name])(spark, sf_dir, staged)
                staged[name] = rows if name in products.SPARK_UNWRITTEN else rows.checkpoint()
            return staged[name]

        return spark.sql(text, **{n: source(n) for n in names})

    return run


def in_duckdb(sql: str) -> str:
    """The SQL for DuckDB; views that are computed once come first, as common tables."""
    full, parts = expand(sql), {}

    def need(text: str) -> None:
        for name in sorted(_names(text) & STAGED):
            if name not in parts:
                own = expand(VIEWS[name])
                need(own)
                parts[name] = own

    need(full)
    head = ", ".join(f"{n} AS MATERIALIZED ({v})" for n, v in parts.items())
    if head:
        start = re.match(r"\s*WITH (RECURSIVE )?", full)
        full = f"WITH {start.group(1) or ''}{head}, {full[start.end():]}" if start else f"WITH {head} {full}"
    return re.sub(r"\{(\w+)\}", r"\1", dialect.spelled(full, dialect.DUCKDB))


FLAGSHIP = "retrieval_f1_topk"
_SQL = {**portable.QUERIES, **recommend.QUERIES, **products.QUERIES, **dialogue.QUERIES}
_FORMS = {**ordered.FORMS, **recommend.FORMS, **products.FORMS, **dialogue.FORMS}
_FORM_SQL = {**shaped.ORACLE_SQL, **generation.ORACLE_SQL, **pairs.ORACLE_SQL, **recommend.FORM_SQL, **products.FORM_SQL, **dialogue.FORM_SQL, **learning.ORACLE_SQL}


def _bound(form: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        staged: dict[str, DataFrame] = {}
        return form(lambda sql, **own: in_spark(sql if "SELECT" in sql else f"SELECT * FROM {sql} t")(spark, sf_dir, staged, **own))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{k: in_spark(v) for k, v in _SQL.items()},
    **{k: _bound(v) for k, v in _FORMS.items()},
    **shaped.QUERIES,
    **generation.QUERIES,
    **pairs.QUERIES,
    **learning.QUERIES,
}
ORACLE_SQL: dict[str, str] = {k: in_duckdb(v) for k, v in {**_SQL, **_FORM_SQL}.items()}
