"""Grouping and clustering (CL2 to CL6)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.components import components
from corpusloom.operators.joins import similar_pairs


def star_edges(df: DataFrame, key: str, value: Column, within: str | None = None) -> DataFrame:
    """CL2: (a, b): each row to the smallest row with its value (and stratum). A star instead of all pairs, so a value with
    a third of all rows gives one edge a row; the smallest is found by an aggregate that combines before the shuffle."""
    cols = [value.alias("v"), F.col(key).alias("k"), (F.col(within) if within else F.lit(0)).alias("s")]
    x = df.select(*cols).where("v is not null and v <> '' and k is not null")
    least = x.groupBy("s", "v").agg(F.min("k").alias("m"), F.count("*").alias("n")).where("n > 1").select("s", "v", "m")
    on = x.s.eqNullSafe(least.s) & (x.v == least.v)
    return x.join(least, on).where("k <> m").select(F.col("m").alias("a"), F.col("k").alias("b"))


def with_groups(df: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """df with root: the smallest key of its component, itself if it has no edge."""
    roots = components(edges).withColumnsRenamed({"node": key})
    return df.join(roots, key, "left").withColumn("root", F.coalesce("root", F.col(key)))


def exact_groups(df: DataFrame, key: str, value: Column, within: str) -> DataFrame:
    """CL2 alone: (key, root): equal values of a stratum are a group already, so its root is the least key of the value, found
    by an aggregate. Rows without a value are their own root."""
    x = df.select(F.col(key), F.col(within).alias("_s"), F.when(value != "", value).alias("_v"))
    least = x.where("_v is not null").groupBy("_s", "_v").agg(F.min(key).alias("root"))
    return x.alias("x").join(least.alias("l"), F.col("x._s").eqNullSafe(F.col("l._s")) & (F.col("x._v") == F.col("l._v")), "left").select(F.col(f"x.{key}").alias(key), F.coalesce("root", f"x.{key}").alias("root"))


def group_ids(grouped: DataFrame, stratum: str, prefix: str = "g-") -> DataFrame:
    """CL5: group ids numbered over strata in order and groups by smallest member. The numbers are positions in one order of all
    groups, given by ranges of it, so no stratum has to fit into a task."""
    from corpusloom.operators.profile import batches

    g = grouped.select(F.col(stratum).alias("_s"), F.col("root").alias("_root")).distinct()
    x = batches(g, F.struct("_s", "_root"), 1).select("_s", "_root", F.format_string(prefix + "%06d", F.col("position")).alias("group_new"))
    return grouped.join(x, (F.col("root") == F.col("_root")) & F.col(stratum).eqNullSafe(F.col("_s"))).drop("_root", "_s")


def single_linkage(df: DataFrame, key: str, vector: str, stratum: str, threshold: float) -> DataFrame:
    """CL3: (key, stratum, root) by edges of at least this similarity inside a stratum."""
    edges = similar_pairs(df, key, vector, threshold, stratum).select("a", "b")
    return with_groups(df.select(key, stratum), key, edges)


def _average_linkage(v: np.ndarray, cut: float, complete: bool = False) -> np.ndarray:
    """Cluster number of each row: merges of least average (or largest) cosine distance, up to the cut."""
    n = len(v)
    d = 1.0 - v @ v.T
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    while alive.sum() > 1:
        flat = int(d.argmin())
        i, j = sorted(divmod(flat, n))
        if d[i, j] > cut + 1e-12:
            break
        new = np.maximum(d[i], d[j]) if complete else (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return label


def average_linkage(df: DataFrame, key: str, vector: str, stratum: str, threshold: float, largest: int = 4000, complete: bool = False) -> DataFrame:
    """CL4 without its unions, which linkage_groups() adds: (key, stratum, cluster) by average or complete linkage inside a
    stratum; cluster is its smallest key. The method needs the whole distance table of a stratum, so a larger stratum is first cut into its single-linkage components at the same
    threshold: clusters whose average similarity reaches the threshold hold a pair that reaches it, so no cluster spans
    two components. A component beyond ``largest`` rows stops with an error and is never cut."""
    parts = single_linkage(df, key, vector, stratum, threshold).withColumnsRenamed({"root": "part"})
    x = df.select(key, vector).join(parts, key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > largest:
            raise ValueError(f"a component of {len(pdf)} rows; raise 'largest' or the threshold")
        pdf = pdf.sort_values(key)
        label = _average_linkage(np.array(pdf[vector].tolist(), np.float64), 1 - threshold, complete)
        keys = pdf[key].to_numpy()
        return pd.DataFrame({key: keys, stratum: pdf[stratum].to_numpy(), "cluster": keys[label]})

    kinds = dict(df.dtypes)
    return x.groupBy("part").applyInPandas(run, f"{key} {kinds[key]}, {stratum} {kinds[stratum]}, cluster {kinds[key]}")


def linkage_groups(df: DataFrame, key: str, vector: str, stratum: str, values: list[Column], threshold: float, complete: bool = False) -> DataFrame:
    """CL4: (key, stratum, root): clusters of average or complete linkage, then joined where rows of a stratum share one of
    the values (CL2). Rows without a vector are joined by values alone."""
    made = average_linkage(df.where(F.col(vector).isNotNull()), key, vector, stratum, threshold, complete=complete)
    edges = made.where(F.col("cluster") != F.col(key)).select(F.col("cluster").alias("a"), F.col(key).alias("b"))
    for v in values:
        edges = edges.unionByName(star_edges(df, key, v, stratum))
    return with_groups(df.select(key, stratum), key, edges)


def recommend_linkage(stats: DataFrame) -> DataFrame:
    """CL6: single if no stratum is near collapse, average otherwise."""
    return stats.agg(F.when(F.count_if("near_collapse") == 0, "single").otherwise("average").alias("linkage"))
