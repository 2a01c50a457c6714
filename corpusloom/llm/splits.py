"""Splits that keep related records together (problem 5).

Records and the entities they name (group number, thread) form a bipartite graph. A record with one entity adds nothing to
connectivity, so the propagation runs on the entities, joined by records that name two; minimum labels are propagated over
them until nothing moves, then given to the records.

Whole sets are then given to splits. Large sets (more than ``large_share`` of all rows; there can be at most 1/large_share
of them) are placed one after another, largest first, where the squared deviation of the label counts from their targets
grows least. All others are dealt out within their main label by systematic sampling: sets in hashed order are laid end to
end by size, and the line is cut at the shares that the large sets left open. Running sums are taken in two steps (buckets,
then inside them), so no label, however frequent, has to fit into one task.

Defined results: a null or stand-in entity relates nothing; a null label is a label of its own; rows with a null id are left
out; a repeated id stays one record; an empty table gives no rows; extra columns are ignored. More than MOST_LABELS labels are
an error. The joins by group and thread have one row a key on their small side, so a hot key is only many rows of the large
side, which Spark's skew join splits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.pairs import group_number
from corpusloom.operators.components import components
from corpusloom.session import materialize

SHARES = (("train", 0.8), ("val", 0.1), ("test", 0.1))


#: Label totals are read by the driver, which cuts them into shares; more labels are an error.
MOST_LABELS = 100_000


def thread_name(c) -> F.Column:
    """A real thread reference (it holds a digit), trimmed and in lower case; null for blanks and stand-ins."""
    t = F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))
    return F.when(t.rlike("[0-9]"), t)


def label_name(c) -> F.Column:
    """One spelling of a label."""
    return F.regexp_replace(F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")), r"[\s\-_]+", "_")


def _records(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("string").alias("id"), group_number(F.col("group_id")).alias("g"), thread_name(F.col("thread_ref")).alias("t"), label_name(F.col("intent")).alias("label")).where("id is not null")


def _entity_roots(recs: DataFrame) -> DataFrame:
    """(node, root) for the entities that records join to others; nodes are g:<number> and t:<thread>."""
    edges = recs.where("g is not null and t is not null").select(F.concat(F.lit("g:"), "g").alias("a"), F.concat(F.lit("t:"), "t").alias("b"))
    return components(edges)


def related_sets(df: DataFrame) -> DataFrame:
    """(id, root_id) for each set of related records with more than one group; root_id is the smallest id of the set."""
    recs = _records(df)
    roots = _entity_roots(recs)
    several = roots.where("node like 'g:%'").groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    kept = materialize(roots.join(several, "root"))
    by_g = kept.where("node like 'g:%'").select(F.substring("node", 3, 1 << 20).alias("g"), F.col("root").alias("rg"))
    by_t = kept.where("node like 't:%'").select(F.substring("node", 3, 1 << 20).alias("t"), F.col("root").alias("rt"))
    member = recs.select("id", "g", "t").join(by_g, "g", "left").join(by_t, "t", "left").select("id", F.coalesce("rg", "rt").alias("root")).where("root is not null").distinct()
    least = member.groupBy("root").agg(F.min("id").alias("root_id"))
    return member.join(least, "root").select("id", "root_id")


def _sets(df: DataFrame) -> DataFrame:
    """(id, label, s): the set of each record; a record alone is a set of its own."""
    recs = _records(df)
    roots = materialize(_entity_roots(recs))
    by_g = roots.where("node like 'g:%'").select(F.substring("node", 3, 1 << 20).alias("g"), F.col("root").alias("rg"))
    by_t = roots.where("node like 't:%'").select(F.substring("node", 3, 1 << 20).alias("t"), F.col("root").alias("rt"))
    got = recs.join(by_g, "g", "left").join(by_t, "t", "left")
    own = F.coalesce("rg", "rt", F.concat(F.lit("g:"), "g"), F.concat(F.lit("t:"), "t"), F.concat(F.lit("r:"), "id"))
    return got.select("id", F.coalesce("label", F.lit("")).alias("label"), own.alias("s")).dropDuplicates(["id"])


def _place_large(large: list, totals: dict[str, int], shares) -> tuple[dict[str, str], dict[tuple[str, str], float]]:
    """Split of each large set, and what the large sets took of each (label, split)."""
    sizes: dict[str, dict[str, int]] = {}
    for s, label, n in large:
        sizes.setdefault(s, {})[label] = n
    took: dict[tuple[str, str], float] = {}
    rows = {k: 0.0 for k, _ in shares}
    total = sum(totals.values())
    where = {}
    for s in sorted(sizes, key=lambda s: (-sum(sizes[s].values()), s)):
        n = sum(sizes[s].values())

        def cost(split, share, n=n, s=s):
            more = sum((took.get((x, split), 0) + c - share * totals[x]) ** 2 - (took.get((x, split), 0) - share * totals[x]) ** 2 for x, c in sizes[s].items())
            over = max(0.0, rows[split] + n - share * total)
            return more / max(1.0, share) + (over / max(1.0, share)) ** 2

        where[s] = min(shares, key=lambda k: (cost(*k), -k[1]))[0]
        rows[where[s]] += n
        for x, c in sizes[s].items():
            took[x, where[s]] = took.get((x, where[s]), 0) + c
    return where, took


def assign_splits(df: DataFrame, shares=SHARES, large_share: float = 0.002, per_bucket: int = 50_000, seed: str = "split") -> DataFrame:
    """(id, split_new, set_id): every record, its set and the split of the set."""
    spark = df.sparkSession
    recs = materialize(_sets(df))
    counts = materialize(recs.groupBy("s", "label").agg(F.count("*").alias("n")))
    sets = counts.groupBy("s").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("m")).select("s", "n", F.col("m.label").alias("main"))
    sets = materialize(sets)
    if counts.select("label").distinct().limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels to balance")
    totals = {r.label: r.n for r in counts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    total = sum(totals.values())
    bound = max(1, math.floor(large_share * total))
    big = sets.where(F.col("n") > bound)
    where, took = _place_large([tuple(r) for r in counts.join(big.select("s"), "s").select("s", "label", "n").collect()], totals, shares)
    # what stays open of each label for the small sets, never below zero
    rest, mains = [], {r.main: r.n for r in sets.where(F.col("n") <= bound).groupBy("main").agg(F.sum("n").alias("n")).collect()}
    spare = {k: share * total - sum(v for (_, s), v in took.items() if s == k) for k, share in shares}
    need = {}
    for label in mains:
        need[label] = {k: max(0.0, share * totals.get(label, 0) - took.get((label, k), 0)) for k, share in shares}
    # scale each split so that its rows fit what is spare of it over all labels
    for _ in range(20):
        for k, _share in shares:
            have = sum(mains[x] * need[x][k] / max(1e-9, sum(need[x].values())) for x in mains)
            if have > 0:
                for x in mains:
                    need[x][k] *= max(0.0, spare[k]) / have
    for label, n in mains.items():
        all_ = sum(need[label].values())
        at = 0.0
        for k, share in shares:
            part = need[label][k] / all_ if all_ > 0 else share
            rest.append((label, k, at, at + part * n))
            at += part * n
    cuts = spark.createDataFrame(rest or [("", "train", 0.0, 0.0)], "main string, split_new string, lo double, hi double")
    ends = cuts.groupBy("main").agg(F.sort_array(F.collect_list(F.struct("hi", "split_new"))).alias("ends"))
    buckets = max(1, math.ceil(total / per_bucket))
    small = sets.where(F.col("n") <= bound).withColumn("o", F.xxhash64(F.lit(seed), "s")).withColumn("b", F.expr(f"pmod(shiftright(o, 20), {buckets})"))
    before = small.groupBy("main", "b").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("main").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("main", "b", "base")
    line = small.withColumn("run", F.sum("n").over(W.partitionBy("main", "b").orderBy("o", "s").rowsBetween(W.unboundedPreceding, 0))).join(before, ["main", "b"])
    placed = line.join(ends, "main").withColumn("mid", F.col("base") + F.col("run") - F.col("n") / 2.0)
    placed = placed.select("s", F.expr("coalesce(filter(ends, e -> e.hi > mid)[0].split_new, element_at(ends, -1).split_new)").alias("split_new"))
    if where:
        placed = placed.unionByName(spark.createDataFrame(list(where.items()), "s string, split_new string"))
    return recs.join(placed, "s").select("id", "split_new", F.col("s").alias("set_id"))


def split_balance(df: DataFrame, assigned: DataFrame) -> DataFrame:
    """(label, split_new, n, share): records of each label by split, with the share of the label."""
    x = assigned.join(_records(df).select("id", F.coalesce("label", F.lit("")).alias("label")).dropDuplicates(["id"]), "id")
    n = x.groupBy("label", "split_new").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("label").agg(F.sum("n").alias("all")), "label").select("label", "split_new", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))
