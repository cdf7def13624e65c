"""Mean activation per unit and the least active units of each layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unit_activation_mean(df: DataFrame, layer: str, vector: str, batch: str | None = None) -> DataFrame:
    """Mean absolute value per layer and position.

    Only values count: a null or NaN element has no part in its unit's mean, and
    a row that lacks a unit has none in that unit. Without ``batch`` every value
    counts alike; with it the result is the mean of the batch means of the unit.
    Sums are combined within each task before every shuffle.
    """
    cell = [layer] if batch is None else [layer, batch]
    long = df.select(*cell, F.posexplode(vector).alias("unit", "value")).withColumn("value", F.col("value").cast("double"))
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    means = long.groupBy(*cell, "unit").agg(F.avg(F.abs("value")).alias("mean_abs"))
    if batch is not None:
        means = means.groupBy(layer, "unit").agg(F.avg("mean_abs").alias("mean_abs"))
    return means


def layer_census(df: DataFrame, layer: str, vector: str) -> DataFrame:
    """Units per layer."""
    return df.groupBy(layer).agg(F.max(F.size(vector)).alias("n_units"), F.count(F.lit(1)).alias("n_rows"))


def bottom_k_units(means: DataFrame, layer: str, percent: float) -> DataFrame:
    """The ``int(n * percent / 100)`` least active units of each layer; ties by position.

    A layer has as many rows here as it has units, which the model fixes.
    """
    of_layer = Window.partitionBy(layer)
    ranked = means.withColumn("rank", F.row_number().over(of_layer.orderBy("mean_abs", "unit"))).withColumn(
        "_units", F.count(F.lit(1)).over(of_layer)
    )
    return ranked.filter(F.col("rank") <= F.floor(F.col("_units") * percent / 100)).drop("_units")


def unit_map_json(chosen: DataFrame, layer: str) -> DataFrame:
    """The choice as one JSON object, layer to positions in order of rank."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "unit")))
    per_layer = chosen.groupBy(layer).agg(F.transform(ranked, lambda x: x["unit"]).alias("units"))
    entries = F.sort_array(F.collect_list(F.struct(F.col(layer).cast("string").alias("k"), "units")))
    return per_layer.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def batch_health(df: DataFrame, vector: str, width: int, by: str) -> DataFrame:
    """Rows with NaN, infinite values or an unexpected shape, per group."""
    v = F.col(vector)
    inf = float("inf")
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.exists(v, lambda x: F.isnan(x))).alias("n_nan"),
        F.count_if(F.exists(v, lambda x: F.abs(x) == inf)).alias("n_inf"),
        F.count_if(v.isNull() | (F.size(v) != width)).alias("n_shape"),
    )
