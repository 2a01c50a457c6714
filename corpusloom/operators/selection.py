"""Sampling, splitting and capping (SP1 to SP15). Orders are hash orders, which every engine computes alike; ties end with
the key. Ranks inside strata are windows; where a stratum may be large, rows are ranked as groups or quotas first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def split_counts(n: Column) -> dict[str, Column]:
    """SP1: groups for train, val and test out of n: a tenth each, rounded half to even, at least one."""
    tenth = F.greatest(F.bround(n * 0.1).cast("int"), F.lit(1))
    val = F.when(n <= 2, 0).when(n - 2 * tenth < 1, F.floor((n - 1) / 2).cast("int")).otherwise(tenth)
    test = F.when(n <= 1, 0).when(n == 2, 1).when(n - 2 * tenth < 1, n - 1 - F.floor((n - 1) / 2).cast("int")).otherwise(tenth)
    return {"train": F.when(n <= 0, 0).otherwise(n - val - test).cast("int"), "val": val.cast("int"), "test": test.cast("int")}


def split_groups(df: DataFrame, stratum: str, group: str, seed: str = "42") -> DataFrame:
    """SP2: (stratum, group, split): whole groups, in hash order inside each stratum. A group's rank is its position in one
    order of all groups less the first position of its stratum, so no stratum has to fit into a task."""
    from corpusloom.operators.profile import batches

    g = df.where(F.col(group).isNotNull()).select(stratum, group).distinct()
    x = batches(g, F.struct(F.col(stratum), X.hash_order(seed, F.col(group)), F.col(group)), 1)
    first = x.groupBy(F.col(stratum).alias("_s")).agg(F.min("position").alias("first"), F.count("*").cast("int").alias("n"))
    x = x.join(first, F.col(stratum).eqNullSafe(F.col("_s"))).withColumn("r", F.col("position") - F.col("first") + 1)
    c = split_counts(F.col("n"))
    return x.select(stratum, group, F.when(F.col("r") <= c["train"], "train").when(F.col("r") <= c["train"] + c["val"], "val").otherwise("test").alias("split_new"))


def cap_groups(df: DataFrame, stratum: str, group: str, cap: int, seed: str = "42", exempt: Column | None = None) -> DataFrame:
    """SP3, SP4: rows of whole groups, at most ``cap`` rows: strata take turns, each offering its next group in hash order;
    a group that does not fit makes its stratum wait, and the choice ends with a turn that adds nothing. Exempt rows are
    kept and count against the cap.

    The choice depends on every earlier one, so it is made over group sizes in one task; that table has at most ``cap``
    groups a stratum, as a stratum sends its groups only up to a running size of the cap."""
    out = df if exempt is None else df.where(~exempt)
    free = cap if exempt is None else cap - df.where(exempt).count()
    if free < 1 <= cap and exempt is not None:
        return cap_groups(df, stratum, group, cap, seed)  # the exempt rows alone fill the cap, so all are capped alike
    g = out.groupBy(stratum, group).agg(F.count("*").alias("n"))
    w = W.partitionBy(stratum).orderBy(X.hash_order(seed, F.col(group)), group)
    # a stratum stops at its first group that does not fit, so what follows its running sum beyond the cap is never chosen
    g = g.withColumn("run", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("r", F.row_number().over(w)).where(F.col("run") - F.col("n") <= max(free, 0))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        queues = {k: list(x.sort_values("r")[[group, "n"]].itertuples(index=False, name=None)) for k, x in pdf.groupby(stratum, dropna=False)}
        order, left, taken = sorted(queues, key=str), free, []
        moved = True
        while moved:
            moved = False
            for k in order:
                if queues[k] and queues[k][0][1] <= left:
                    got, n = queues[k].pop(0)
                    left -= n
                    taken.append((k, got))
                    moved = True
        return pd.DataFrame(taken, columns=[stratum, group])

    kinds = dict(df.dtypes)
    chosen = g.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(choose, f"{stratum} {kinds[stratum]}, {group} {kinds[group]}")
    kept = out.alias("o").join(chosen.alias("c"), F.col(f"o.{stratum}").eqNullSafe(F.col(f"c.{stratum}")) & F.col(f"o.{group}").eqNullSafe(F.col(f"c.{group}")), "left_semi")
    return kept if exempt is None else kept.unionByName(df.where(exempt))


def quota(df: DataFrame, stratum: str, group: str, key: str, k: int, seed: str) -> DataFrame:
    """SP5, SP15: up to k rows per stratum, each of another group, in hash order. A group's first row is an aggregate,
    so large groups shrink to one row before anything is ranked."""
    o = X.hash_order(seed, F.col(key))
    first = df.groupBy(stratum, group).agg(F.min(F.struct(o.alias("o"), F.col(key).alias(key))).alias("x")).select(stratum, group, "x.o", f"x.{key}")
    return first.withColumn("r", F.row_number().over(W.partitionBy(stratum).orderBy("o", key))).where(F.col("r") <= k).select(stratum, group, key, "r")


def curated(df: DataFrame, stratum: str, group: str, key: str, text: Column, k: int, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SP5: (selected rows with their rank, keys left out for a wording of slot rewriting, strata with fewer than k groups):
    the exact digest order of "v3-curation:{seed}:{key}", of each group its first row."""
    from corpusloom.operators.rules import without_artifacts

    good, out = without_artifacts(df, key, text)
    o = F.sha2(F.concat_ws(":", F.lit("v3-curation"), F.lit(seed), F.col(key).cast("string")), 256)
    first = good.groupBy(stratum, group).agg(F.min(F.struct(o.alias("o"), F.col(key).alias(key))).alias("x")).select(stratum, group, "x.o", f"x.{key}")
    got = first.withColumn("r", F.row_number().over(W.partitionBy(stratum).orderBy("o", key))).where(F.col("r") <= k).drop("o")
    n = df.select(stratum).distinct().join(first.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("n")), F.col(stratum).eqNullSafe(F.col("_s")), "left").select(stratum, F.coalesce("n", F.lit(0)).alias("n_groups"))
    return got, out, n.where(F.col("n_groups") < k)


def micro_batches(df: DataFrame, key: str, seed: int, size: int, start: int = 0, n: int | None = None) -> DataFrame:
    """SP9, SM5: (key, cursor, epoch, batch): the batches of one epoch in its hash order, from the global cursor ``start`` on; rows
    that fill no batch are left out of the epoch. The cursor says the epoch, so a later call goes on where one ended."""
    from corpusloom.operators.profile import batches

    rows = df.count()
    per = max(1, rows // size)
    epoch = start // per
    x = batches(df.select(key), F.struct(X.hash_order(f"epoch:{seed + epoch}", F.col(key)), key), size).where(F.col("batch") < per)
    x = x.select(key, (F.lit(epoch * per) + F.col("batch")).cast("long").alias("cursor"), F.lit(epoch).alias("epoch"), F.col("batch").cast("long").alias("batch")).where(F.col("cursor") >= start)
    return x if n is None else x.where(F.col("cursor") < start + n)


def cells_left(cells: DataFrame, rows: DataFrame, by: list[str], want: str, seed: str, redo: DataFrame | None = None) -> DataFrame:
    """SP13, SM4: cells (by..., want) still to do with their place in a seeded order: those without their quota of rows, or, with
    a list of cells to redo, those in it and those without any row."""
    have = rows.groupBy(*by).agg(F.count("*").alias("have"))
    x = cells.join(have, by, "left").na.fill(0, ["have"])
    if redo is None:
        x = x.where(F.col("have") < F.col(want))
    else:
        x = x.join(redo.select(*by).distinct().withColumn("again", F.lit(True)), by, "left").where("have < 1 or again").drop("again")
    return x.withColumn("place", X.hash_order(seed, *[F.col(c) for c in by]))


def quota_backfilled(df: DataFrame, stratum: str, group: str, key: str, k: int, n: int, seed: str) -> DataFrame:
    """SP6: (stratum, group, key, backfilled): up to k groups per stratum in hash order, a row each, then what is missing of
    n taken from the groups left, strata taking turns, those with most groups left first. A group counts once over all
    strata: it stays with the first stratum that has it. An error where all groups are fewer than n.

    A stratum gives at most one group a turn, so the turn of a group is its rank among those left, and the order inside a
    turn is the number left then, which falls by one each turn alike: the order of the first turn holds for all."""
    o = X.hash_order(seed, F.col(key))
    one = df.where(F.col(group).isNotNull()).groupBy(stratum, group).agg(F.min(F.struct(o.alias("o"), F.col(key).alias(key))).alias("x"))
    owner = one.groupBy(group).agg(F.min(F.struct(F.col(stratum).isNotNull().alias("known"), F.col(stratum).alias("s"), F.col("x").alias("x"))).alias("y"))
    g = owner.select(F.col("y.s").alias(stratum), group, F.col(f"y.x.{key}").alias(key), X.hash_order(seed + ":group", F.col(group)).alias("go"))
    g = g.withColumn("r", F.row_number().over(W.partitionBy(stratum).orderBy("go", group)))
    left = g.groupBy(stratum).agg(F.count("*").alias("groups")).withColumnsRenamed({stratum: "_s"})
    taken, all_groups = left.agg(F.coalesce(F.sum(F.least("groups", F.lit(k))), F.lit(0)), F.coalesce(F.sum("groups"), F.lit(0))).first()
    if all_groups < n:
        raise ValueError(f"{n} distinct groups wanted, {all_groups} available")
    base = g.where(F.col("r") <= k).select(stratum, group, key, F.lit(False).alias("backfilled"))
    spare = g.where((F.col("r") > k) & (F.col("r") <= k + n)).join(left, F.col(stratum).eqNullSafe(F.col("_s")))
    more = spare.orderBy("r", F.desc("groups"), F.asc_nulls_first(stratum)).limit(max(0, n - taken))
    return base.unionByName(more.select(stratum, group, key, F.lit(True).alias("backfilled")))


def banded_pairs(pairs: DataFrame, stratum: str, band: str, a: Column, b: Column, wanted: dict[str, int], seed: str, per: int = 80) -> DataFrame:
    """SP7: the pairs (row_a, row_b, ...) of a sample: up to ``per`` a (stratum, band) in hash order, one of those with the
    same unordered pair of texts a, b in a band, then strata taking turns until the band has what is wanted."""
    h = X.hash_order(seed, F.col(band), F.col("row_a"), F.col("row_b"))
    key = [F.col("h"), F.col("row_a"), F.col("row_b")]
    x = pairs.where(F.col(band).isin(*wanted)).withColumns({"h": h, "t1": F.least(a, b), "t2": F.greatest(a, b)})
    x = x.withColumn("k", F.row_number().over(W.partitionBy(stratum, band).orderBy(*key))).where(F.col("k") <= per)
    x = x.withColumn("k", F.row_number().over(W.partitionBy(band, "t1", "t2").orderBy(*key))).where("k = 1")
    x = x.withColumn("k", F.row_number().over(W.partitionBy(band, stratum).orderBy(*key)))
    turn = W.partitionBy(band).orderBy("k", X.hash_order(seed + ":turn", F.col(band), F.col(stratum)), F.asc_nulls_first(stratum))
    n = F.create_map(*[F.lit(v) for kv in wanted.items() for v in kv])
    x = x.withColumn("place", F.row_number().over(turn)).where(F.col("place") <= n[F.col(band)])  # at most per x strata rows a band
    return x.drop("h", "t1", "t2", "k")


def interleave(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """SP8: n rows, strata taking turns in hash order. Only the first n of each stratum can be chosen."""
    o = X.hash_order(seed, F.col(key))
    x = df.select(stratum, key, F.row_number().over(W.partitionBy(stratum).orderBy(o, key)).alias("r")).where(F.col("r") <= n)
    return x.orderBy("r", F.asc_nulls_first(stratum)).limit(n)


def balanced_sides(df: DataFrame, key: str, seed: str) -> DataFrame:
    """SP10: (key, base_first): exactly the floor of half of the rows get true, by hash order."""
    n = df.count()
    first = df.select(key, X.hash_order(seed, F.col(key)).alias("o")).orderBy("o", key).limit(n // 2).select(key, F.lit(True).alias("base_first"))
    return df.select(key).join(first, key, "left").na.fill(False, ["base_first"])


def coin_sides(df: DataFrame, key: str, seed: str) -> DataFrame:
    """SP11: an independent coin per item, from its hash, and a place by another hash."""
    h = X.hash_order(seed, F.col(key))
    return df.select(key, (F.conv(F.substring(h, 1, 1), 16, 10).cast("int") % 2 == 0).alias("base_first"), X.hash_order(seed + ":place", F.col(key)).alias("place"))


def greedy_gram_dedup(df: DataFrame, block: str, order: str, grams: str) -> DataFrame:
    """SP14: rows kept in order unless they share a gram with a kept row of their block. A rejected row blocks nothing, so
    the choice is sequential; rows that share no gram with any other row are kept without it, and the rest is cut into the
    connected components of "share a gram", each of which is decided alone."""
    from corpusloom.operators.components import components
    from corpusloom.session import materialize

    x = materialize(df.select(block, order, F.col(grams).alias("g")))
    e = x.select(order, F.explode("g").alias("gram"), block)
    first = e.groupBy(block, "gram").agg(F.min(order).alias("m"), F.count("*").alias("n")).where("n > 1")
    edges = e.alias("e").join(first.alias("f"), F.col(f"e.{block}").eqNullSafe(F.col(f"f.{block}")) & (F.col("e.gram") == F.col("f.gram"))).select(F.col("f.m").alias("a"), F.col(f"e.{order}").alias("b"))
    roots = components(edges)
    alone = x.join(roots.select(F.col("node").alias(order)), order, "left_anti").select(block, order)
    tied = x.join(roots.select(F.col("node").alias(order), "root"), order)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: set = set()
        kept = []
        for b, o, g in pdf.sort_values(order)[[block, order, "g"]].itertuples(index=False, name=None):
            if not seen.intersection(g):
                seen.update(g)
                kept.append((b, o))
        return pd.DataFrame(kept, columns=[block, order])

    kinds = dict(df.dtypes)
    return alone.unionByName(tied.groupBy("root").applyInPandas(keep, f"{block} {kinds[block]}, {order} {kinds[order]}"))
