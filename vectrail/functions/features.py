"""Feature transforms that stay in Catalyst: window moments, histograms, bags of words, ragged vectors, one-hot columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.functions.vectors import total


def moments(v: Column) -> Column:
    """Struct of mean, population deviation, and population skew (0 where nothing varies)."""
    n = F.size(v)
    mean = total(v) / n
    power = lambda p: total(F.transform(v, lambda x: F.pow(x - mean, F.lit(float(p))))) / n
    skew = F.when(power(2) == 0, F.lit(0.0)).otherwise(F.try_divide(power(3), F.pow(power(2), F.lit(1.5))))
    return F.struct(mean.alias("mean"), F.sqrt(power(2)).alias("std"), skew.alias("skew"))


def windows(v: Column, width: int) -> Column:
    """Consecutive slices; the last may be shorter."""
    return F.transform(F.sequence(F.lit(1), F.size(v), F.lit(width)), lambda s: F.slice(v, s, F.lit(width)))


def window_moments(rows: DataFrame, width: int, id_col: str = "image_id", features: str = "features") -> DataFrame:
    """id, window (from 0), mean, std, skew."""
    each = rows.select(id_col, F.posexplode(windows(F.col(features), width)).alias("window", "v"))
    return each.select(id_col, "window", moments(F.col("v")).alias("m")).select(id_col, "window", "m.*")


def moment_vector(v: Column, width: int) -> Column:
    """All windows' moments, one after the other."""
    return F.flatten(F.transform(windows(v, width), lambda w: F.array(moments(w)["mean"], moments(w)["std"], moments(w)["skew"])))


def sign_codes(v: Column, lag: int = 3) -> Column:
    """1 where the element `lag` places on is at least as large: a one-neighbour binary pattern. Nothing counts as 0 beyond the end."""
    return F.transform(v, lambda x, i: (F.coalesce(F.get(v, i + lag), F.lit(0.0)) >= x).cast("int"))


def shares(values: DataFrame, by: list[str], value: str, epsilon: float = 1e-7) -> DataFrame:
    """by, value, n, share: counts of each value and their share of the group (sum + epsilon), as histograms are normalised."""
    counts = values.groupBy(*by, value).agg(F.count("*").alias("n"))
    sums = counts.groupBy(*by).agg(F.sum("n").alias("all"))
    return counts.join(sums, by).select(*by, value, "n", (F.col("n") / (F.col("all") + F.lit(epsilon))).alias("share"))


def equal_bins(v: Column, bins: int = 10) -> Column:
    """Bin number (from 0) of each element over the vector's own range, the last bin closed."""
    low, high = F.array_min(v), F.array_max(v)
    lo, width = F.when(low == high, low - 0.5).otherwise(low), F.when(low == high, F.lit(1.0)).otherwise(high - low)
    return F.transform(v, lambda x: F.least(F.floor((x - lo) / width * bins), F.lit(bins - 1)).cast("int"))


def bag_of_words(rows: DataFrame, id_col: str = "image_id", features: str = "features") -> DataFrame:
    """id, word, n: counts of each truncated value, numbered from the least over all rows (so none wrap around)."""
    words = rows.select(id_col, F.explode(features).alias("x")).select(id_col, F.col("x").cast("int").alias("v"))
    counts = words.groupBy(id_col, "v").agg(F.count("*").alias("n"))
    bias = counts.agg(F.greatest(F.lit(0), -F.min("v")).alias("bias"))
    return counts.crossJoin(F.broadcast(bias)).select(id_col, (F.col("v") + F.col("bias")).alias("word"), "n")


def bag_vectors(rows: DataFrame, id_col: str = "image_id", features: str = "features") -> DataFrame:
    """id, features: dense counts of the same words for every row, as topic models take them."""
    bag = bag_of_words(rows, id_col, features)
    size = bag.agg((F.max("word") + 1).alias("size"))
    held = bag.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("m")).crossJoin(F.broadcast(size))
    places = F.sequence(F.lit(0), F.col("size") - 1)
    return held.select(id_col, F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double")).alias(features))


def truncated(rows: DataFrame, ragged: str, out: str = "features") -> DataFrame:
    """Every row's list of vectors cut to the shortest list and put in one vector."""
    least = rows.agg(F.min(F.size(ragged)).alias("least"))
    return rows.crossJoin(F.broadcast(least)).withColumn(out, F.flatten(F.slice(F.col(ragged), F.lit(1), F.col("least")))).drop("least")


def aligned(ragged: Column, width: int) -> Column:
    """A query's list of vectors as one vector of the matrix's width."""
    return F.slice(F.flatten(ragged), 1, width)


def strongest_first(keypoints: Column) -> Column:
    """Keypoints (response last in each) by falling response, without it."""
    ordered = F.array_sort(F.transform(keypoints, lambda p: F.struct((-F.element_at(p, -1)).alias("r"), p.alias("p"))))
    return F.transform(ordered, lambda s: F.slice(s["p"], F.lit(1), F.size(s["p"]) - 1))


def one_hot(rows: DataFrame, columns: dict[str, list]) -> DataFrame:
    """rows with a 0/1 column `<column>_<value>` for each listed value; null has none."""
    return rows.select("*", *[F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for c, values in columns.items() for v in values])


def values_of(rows: DataFrame, column: str, most: int = 1000) -> list:
    """A column's distinct values, in order; more than `most` are too many for columns of their own."""
    found = [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(found)
