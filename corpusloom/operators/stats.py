"""Bootstrap intervals (BS1 to BS3). Values are first reduced to (sum, n) per cluster. The exact mode replays numpy draws on
the driver over that reduced table, whose size is bounded by a parameter; the Spark mode draws clusters by a hash of (seed, draw, slot), which any
engine can repeat, and never leaves the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reduce_clusters(df: DataFrame, cluster: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count("*").alias("n"))


def bootstrap_hash(clusters: DataFrame, draws: int, seed: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(estimate, low, high) of the row-weighted mean: clusters are numbered, slot i of draw b takes cluster
    hash(seed, b, i) mod k. draws x k slots are generated from the numbered table itself, in parallel."""
    k = clusters.count()
    key = [c for c in clusters.columns if c not in ("s", "n")][0]
    c = clusters.select("s", "n", (F.row_number().over(W.orderBy(F.asc_nulls_first(key))) - 1).alias("i"))
    slots = c.select("i").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col("b").cast("string"), F.col("i").cast("string")))
    slots = slots.select("b", (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % F.lit(max(k, 1))).cast("int").alias("i"))
    drawn = slots.join(c, "i").groupBy("b").agg((F.sum("s") / F.sum("n")).alias("m"))
    est = c.agg((F.sum("s") / F.sum("n")).alias("estimate"))
    ci = drawn.agg(F.percentile("m", low).alias("low"), F.percentile("m", high).alias("high"))
    one = F.lit(1)
    return est.withColumn("j", one).join(ci.withColumn("j", one), "j").select(*[F.round(x, 6).alias(x) for x in ("estimate", "low", "high")])


def reduce_strata(df: DataFrame, stratum: str, value: str) -> DataFrame:
    """BS3: each stratum as one draw of its mean, so the mean over drawn strata weighs them alike."""
    return df.where(F.col(value).isNotNull()).groupBy(stratum).agg(F.avg(F.col(value).cast("double")).alias("s")).withColumn("n", F.lit(1).cast("long"))


def paired_bootstrap_exact(pairs: DataFrame, key: str, stratum: str, value: str, draws: int = 10_000, seed: int = 20260908, most: int = 1_000_000) -> dict[str, tuple[float, float, float]]:
    """BS2, BS3: (estimate, low, high) in points of the difference ``value``: "macro" over strata in order, then "items" over the
    items in key order, from one stream of numpy's generator. On the driver, for at most ``most`` items; draws are made in
    blocks, so memory stays bounded. {} without items."""
    rows = pairs.select(key, F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("s"), F.col(value).cast("double").alias("v")).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} items; use bootstrap_hash")
    if not rows:
        return {}
    by: dict[str, list[float]] = {}
    for r in rows:
        by.setdefault(r.s, []).append(r.v)
    rng, out = np.random.default_rng(seed), {}
    for name, v in (("macro", np.array([np.mean(by[s]) for s in sorted(by)])), ("items", np.array([r.v for r in rows]))):
        means, step = [], max(1, 5_000_000 // len(v))
        for at in range(0, draws, step):
            means.append(v[rng.integers(0, len(v), size=(min(step, draws - at), len(v)))].mean(axis=1) * 100)
        low, high = np.quantile(np.concatenate(means), [0.025, 0.975])
        out[name] = (float(v.mean() * 100), float(low), float(high))
    return out


def bootstrap_exact(clusters: DataFrame, draws: int = 2000, seed: int = 42, most: int = 1_000_000) -> tuple[float, float, float] | None:
    """(mean, low, high) by numpy's generator over clusters in key order; None without clusters."""
    key = [c for c in clusters.columns if c not in ("s", "n")][0]
    rows = clusters.orderBy(F.asc_nulls_first(key)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} clusters; use bootstrap_hash")
    if not rows:
        return None
    s, n = np.array([r.s for r in rows]), np.array([r.n for r in rows], float)
    rng = np.random.default_rng(seed)
    means = np.empty(draws)
    for b in range(draws):
        at = rng.integers(0, len(s), len(s))
        means[b] = s[at].sum() / n[at].sum()
    return float(s.sum() / n.sum()), float(np.percentile(means, 2.5)), float(np.percentile(means, 97.5))
