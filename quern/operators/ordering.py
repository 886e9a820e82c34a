"""Row numbers and running sums over a whole table or a hot key, without a single task that holds it.

The rows are cut into ranges of (keys, order), each range is numbered by itself, and the few keys that reach over a
border (at most two for each range) get what lies before it from a table of that size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import ensure_checkpoint_dir

_PART = "__range"


def numbered(df: DataFrame, keys: list[str], order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """df with `_row` (place among the rows of its key, from 1) and `_n` (rows of its key), and for each column c of sums
    `_run_c` (sum up to this row) and `_all_c` (sum of its key).

    `order` has to decide all ties; without keys the whole table is one key; a null key is a key; an empty table stays empty.
    """
    ensure_checkpoint_dir(df.sparkSession)
    staged = df.repartitionByRange(*(F.col(k) for k in keys), *order).withColumn(_PART, F.spark_partition_id()).checkpoint()
    here = Window.partitionBy(_PART, *keys)
    so_far = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = staged.withColumns({"_row": F.row_number().over(here.orderBy(*order)).cast("long"), "_n": F.count(F.lit(1)).over(here), **{f"_run_{c}": F.sum(c).over(so_far) for c in sums}, **{f"_all_{c}": F.sum(c).over(here) for c in sums}})

    totals = [F.count(F.lit(1)).alias("__rows"), *(F.sum(c).alias(f"__sum_{c}") for c in sums)]
    border = staged
    if keys:
        edge = F.struct(*keys)
        ends = staged.groupBy(_PART).agg(F.array_distinct(F.array(F.min(edge), F.max(edge))).alias("__e")).select(F.col(_PART).alias("__p"), F.explode("__e").alias("__e"))
        border = staged.join(F.broadcast(ends), (F.col(_PART) == F.col("__p")) & edge.eqNullSafe(F.col("__e")), "left_semi")
    border = border.groupBy(_PART, *keys).agg(*totals)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    names = ["rows", *(f"sum_{c}" for c in sums)]
    carried = border.select(F.col(_PART).alias("__p"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(F.sum(f"__{c}").over(before).alias(f"__before_{c}") for c in names), *(F.sum(f"__{c}").over(whole).alias(f"__total_{c}") for c in names))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.col(_PART) == F.col("__p"))
    zero = F.lit(0)
    out = {"_row": F.col("_row") + F.coalesce("__before_rows", zero), "_n": F.coalesce("__total_rows", "_n")}
    for c in sums:
        out |= {f"_run_{c}": F.col(f"_run_{c}") + F.coalesce(f"__before_sum_{c}", zero), f"_all_{c}": F.coalesce(f"__total_sum_{c}", f"_all_{c}")}
    return local.join(F.broadcast(carried), same, "left").select(*df.columns, *(v.alias(k) for k, v in out.items()))
