"""Whitening of vectors by principal components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whiten(rows: DataFrame, fit: DataFrame, vector: str, size: int) -> DataFrame:
    """rows plus `white`: the centred vector on the first components of `fit`, each divided by its deviation, of unit length.

    The mean and the covariance, whose size is the vectors' squared, come from one pass over `fit` (MLlib's summary); of each
    component the largest weight is positive, so that its sign is fixed. Null vectors stay null.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    told = fit.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    centre = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(told)
    flat = centre.transform(told)
    model = PCA(k=size, inputCol="c", outputCol="p").fit(flat)
    axes = model.pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(size)])
    spread = np.array(_variances(flat, axes).first()["spread"])
    axes = axes / np.sqrt(np.maximum(spread, 1e-24))
    mean = centre.mean.toArray()
    x = F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, mean.tolist())), lambda a, m: a - m)
    parts = F.array(*[F.aggregate(F.zip_with(x, F.array(*map(F.lit, axes[:, k].tolist())), lambda a, w: a * w), F.lit(0.0), lambda s, y: s + y) for k in range(size)])
    length = F.sqrt(F.aggregate(F.col("__white"), F.lit(0.0), lambda s, y: s + y * y)) + 1e-12
    return rows.withColumn("__white", F.when(F.col(vector).isNotNull(), parts)).withColumn("white", F.transform("__white", lambda y: y / length)).drop("__white")


def _variances(flat: DataFrame, axes: np.ndarray) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array("c")
    dots = [F.aggregate(F.zip_with(v, F.array(*map(F.lit, axes[:, k].tolist())), lambda a, w: a * w), F.lit(0.0), lambda s, y: s + y) for k in range(axes.shape[1])]
    return flat.select(*[d.alias(f"d{k}") for k, d in enumerate(dots)]).agg(F.array(*[F.var_pop(f"d{k}") for k in range(axes.shape[1])]).alias("spread"))
