"""Alignment, screening and nearest-neighbour joins (JN1 to JN24)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def align(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JN1, JN2, JN6: inner join of tables with the same unique keys."""
    return left.join(right, key)


def align_violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, problem): keys that one side lacks or repeats. Both sides are counted before they meet."""
    a = left.groupBy(key).agg(F.count("*").alias("a"))
    b = right.groupBy(key).agg(F.count("*").alias("b"))
    x = a.join(b, key, "full_outer").select(F.col(key).cast("string").alias("key"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    problem = F.when(F.col("b") == 0, "missing_right").when(F.col("a") == 0, "missing_left").when(F.col("a") > 1, "repeated_left").when(F.col("b") > 1, "repeated_right")
    return x.select("key", problem.alias("problem")).where("problem is not null")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], lid: str, rid: str, per_task: int = 1_000_000) -> DataFrame:
    """Inner join on ``on`` in which no task forms more than about ``per_task`` pairs of a key: rows of keys with more pairs
    are dealt, by the hash of their ids, into a grid of cells with at most isqrt(per_task) rows of either side, and each row
    goes to the cells of its line only. Both sides are counted per key before anything is dealt."""
    edge = math.isqrt(per_task)
    n = left.groupBy(*on).agg(F.count("*").alias("_nl")).join(right.groupBy(*on).agg(F.count("*").alias("_nr")), on)
    lines = lambda c: F.when(F.col("_nl") * F.col("_nr") <= per_task, 1).otherwise(F.ceil(F.col(c) / edge)).cast("int")
    grid = n.select(*on, lines("_nl").alias("_a"), lines("_nr").alias("_b"))
    x = left.join(grid, on).withColumn("_i", F.expr(f"pmod(xxhash64({lid}), _a)")).withColumn("_j", F.explode(F.expr("sequence(0L, _b - 1L)"))).drop("_a", "_b")
    y = right.join(grid, on).withColumn("_j", F.expr(f"pmod(xxhash64({rid}), _b)")).withColumn("_i", F.explode(F.expr("sequence(0L, _a - 1L)"))).drop("_a", "_b")
    return x.join(y, [*on, "_i", "_j"]).drop("_i", "_j")


def screen_by_grams(corpus: DataFrame, key: str, text: Column, held: DataFrame, held_text: Column, n: int = 6) -> DataFrame:
    """JN14, JN15, VA5: (key, n_shared, exact, pass): distinct n-grams a row shares with the held-out texts, and equality
    after normalisation. Words are taken once per text, grams are made from them. A row's equality is carried as one more
    gram, marked, so that one pass and one join give both."""
    words = lambda df, c, *keep: df.select(*keep, X.tokens(c).alias("w")).where("w is not null")
    whole = F.when(F.size("w") > 0, F.array(F.concat(F.lit("="), F.array_join("w", " ")))).otherwise(F.array().cast("array<string>"))
    grams = F.concat(X.ngrams(F.col("w"), n), whole)
    wanted = words(held, held_text).select(F.explode(grams).alias("gram")).distinct()
    got = words(corpus, text, F.col(key).alias("key")).select("key", F.explode(grams).alias("gram")).join(wanted, "gram")
    exact = F.col("gram").startswith("=")
    shared = got.groupBy("key").agg(F.count_if(~exact).alias("n"), F.count_if(exact).alias("e"))
    out = corpus.select(F.col(key).alias("key")).join(shared, "key", "left").select(F.col("key").alias(key), F.coalesce("n", F.lit(0)).alias("n_shared"), (F.coalesce("e", F.lit(0)) > 0).alias("exact"))
    return out.withColumn("pass", (F.col("n_shared") == 0) & ~F.col("exact"))


def gram_sources(corpus: DataFrame, key: str, text: Column, held: DataFrame, held_key: str, held_text: Column, n: int = 6, most: int = 20) -> DataFrame:
    """JN14: (key, gram, n_sources, sources): each shared gram of a row with how many held-out texts have it and the first
    ``most`` of their ids; the count is whole."""
    a = corpus.select(F.col(key).alias("key"), X.tokens(text).alias("w")).select("key", F.explode(X.ngrams(F.col("w"), n)).alias("gram"))
    b = held.select(F.col(held_key).cast("string").alias("source"), X.tokens(held_text).alias("w")).select("source", F.explode(X.ngrams(F.col("w"), n)).alias("gram"))
    from pyspark.sql import Window as W

    counts = b.groupBy("gram").agg(F.count("*").alias("n_sources"))
    first = b.withColumn("r", F.row_number().over(W.partitionBy("gram").orderBy("source"))).where(F.col("r") <= most)  # cut inside each task before the shuffle
    named = first.groupBy("gram").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))
    return a.join(counts, "gram").join(named, "gram").select(F.col("key").alias(key), "gram", "n_sources", "sources")


def coverage_violations(items: DataFrame, sides: dict[str, DataFrame], key: str) -> DataFrame:
    """JN3: (key, problem): items without a row of a side, rows of a side without an item, repeated and failed rows. Each side
    has the key and ``ok``; a sheet is made only if nothing is left here."""
    out = None
    for name, df in sides.items():
        g = df.groupBy(key).agg(F.count("*").alias("n"), F.min("ok").alias("ok"))
        x = items.select(key, F.lit(True).alias("there")).join(g, key, "full_outer")
        problem = F.filter(F.array(F.when(F.col("n").isNull(), f"{name}_missing"), F.when(F.col("there").isNull(), f"{name}_unknown"), F.when(F.col("n") > 1, f"{name}_repeated"), F.when(~F.col("ok"), f"{name}_failed")), lambda p: p.isNotNull())
        y = x.select(key, F.explode(problem).alias("problem"))
        out = y if out is None else out.unionByName(y)
    return out


def group_mismatches(left: DataFrame, right: DataFrame, key: str, group: str) -> DataFrame:
    """JN2: (key, left_group, right_group) where both sides have the key in different groups."""
    x = left.select(key, F.col(group).alias("left_group")).join(right.select(key, F.col(group).alias("right_group")), key)
    return x.where(~F.col("left_group").eqNullSafe(F.col("right_group")))


def unknown_keys(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """JN8, JN17, JN23: (key, problem): wanted keys that are not known, and known ones that are not unique."""
    lacking = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key).distinct(), key, "left_anti").select(key, F.lit("unknown").alias("problem"))
    twice = known.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit("repeated").alias("problem"))
    return lacking.unionByName(twice)


def purge_groups(df: DataFrame, group: str, bad: DataFrame, key: str) -> DataFrame:
    """JN16: all rows of groups without a bad row; rows without a group stand alone."""
    spoiled = df.join(bad.select(key).distinct(), key, "left_semi")
    groups = spoiled.where(F.col(group).isNotNull()).select(group).distinct()
    alone = spoiled.where(F.col(group).isNull()).select(key)
    return df.join(groups, group, "left_anti").join(alone, key, "left_anti")


def split_intersections(df: DataFrame, value: Column, split: str) -> DataFrame:
    """JN20: (pair, n_values): values that occur in both splits of each pair."""
    v = df.select(value.alias("v"), F.col(split).alias("s")).where("v is not null and s is not null").groupBy("v").agg(F.array_sort(F.collect_set("s")).alias("s"))
    pairs = F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> concat(x, '/', y))))")
    return v.where(F.size("s") > 1).select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n_values"))


def straddling_groups(df: DataFrame, group: Column, split: str) -> DataFrame:
    """JN21: (group, n_splits) of groups in more than one split."""
    g = df.select(group.alias("grp"), F.col(split).alias("s")).where("grp is not null and s is not null")
    return g.groupBy("grp").agg(F.count_distinct("s").alias("n_splits")).where("n_splits > 1")


def select_in_order(df: DataFrame, key: str, ids: list) -> DataFrame:
    """JN23: rows of a list of ids with the position of each in the list. The list is a parameter, so it is small."""
    kind = dict(df.dtypes)[key]
    want = df.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{key} {kind}, position int")
    return df.join(F.broadcast(want), key)


def prefer(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """JN19: value of the first table where it has one, else of the second, with its origin."""
    a, b = first.select(key, F.col(value).alias("a")), second.select(key, F.col(value).alias("b"))
    x = a.join(b, key, "full_outer")
    return x.select(key, F.coalesce("a", "b").alias(value), F.when(F.col("a").isNotNull(), "first").otherwise("second").alias("origin"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


# --- vectors --------------------------------------------------------------------------------------------------------

_NEAR = "key long, nearest long, similarity double"


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, block: int = 4096, within: Column | None = None) -> DataFrame:
    """JN9 to JN11: (key, nearest, similarity) of each query's most similar other base row; ties go to the smaller key.

    Blocked matrix products: base and queries are each cut into blocks of about ``block`` rows, each pair of blocks is one
    product in numpy, and the best of each block pair are reduced by key. ``within`` restricts to equal strata, which become
    part of the block key, so unrelated strata never meet. Null vectors are left out; a stratum without another row gives no
    row."""
    s = F.lit(0) if within is None else within
    n, m = (max(1, -(-x.count() // block)) for x in (base, queries))
    b = base.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"), s.alias("s")).where("v is not null and s is not null").withColumn("bb", F.pmod(F.xxhash64("k"), F.lit(n)))
    q = queries.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"), s.alias("s")).where("v is not null and s is not null").withColumn("qb", F.pmod(F.xxhash64("k"), F.lit(m)))
    q = q.withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).groupBy("s", "qb", "bb")
    b = b.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).groupBy("s", "qb", "bb")

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "nearest": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        a, c = np.array(left["v"].to_pylist(), np.float64), np.array(right["v"].to_pylist(), np.float64)
        ka, kc = left["k"].to_numpy(), right["k"].to_numpy()
        order = np.argsort(kc)
        c, kc = c[order], kc[order]
        sim = np.round(a @ c.T, 9)
        sim[ka[:, None] == kc[None, :]] = -np.inf
        at = sim.argmax(1)
        best = sim[np.arange(len(a)), at]
        ok = np.isfinite(best)
        return pa.table({"key": ka[ok], "nearest": kc[at[ok]], "similarity": best[ok]})

    got = q.cogroup(b).applyInArrow(product, _NEAR)
    best = got.groupBy("key").agg(F.max(F.struct("similarity", (-F.col("nearest")).alias("m"))).alias("x"))
    return best.select(F.col("key").alias(key), (-F.col("x.m")).alias("nearest"), F.round("x.similarity", 6).alias("similarity"))


def similar_pairs(df: DataFrame, key: str, vector: str, least: float, within: str, block: int = 2048) -> DataFrame:
    """JN12, JN13: (within, a, b, similarity) of pairs a < b of one stratum with at least this similarity.

    Only pairs of a stratum meet. Each stratum is cut into blocks of about ``block`` rows by the hash of the key, and each
    pair of its blocks is one matrix product in numpy, so a hot stratum is many tasks of bounded size. Null vectors and
    strata are left out."""
    kinds = dict(df.dtypes)
    x = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(within).alias("s")).where("k is not null and v is not null and s is not null")
    n = x.groupBy("s").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    x = x.join(n, "s").withColumn("b", F.expr("cast(pmod(xxhash64(k), n) as int)"))
    one = x.select("s", "k", "v", F.col("b").alias("i"), F.explode(F.expr("sequence(b, n - 1)")).alias("j")).groupBy("s", "i", "j")
    two = x.select(*[F.col(c).alias(c) for c in ("s", "k", "v")], F.col("b").alias("j"), F.explode(F.expr("sequence(0, b)")).alias("i")).groupBy("s", "i", "j")

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        ka, kc = left["k"].combine_chunks(), right["k"].combine_chunks()
        if not len(ka) or not len(kc):
            return pa.table({"s": left["s"].slice(0, 0), "a": ka.slice(0, 0), "b": ka.slice(0, 0), "similarity": pa.array([], pa.float64())})
        sim = np.array(left["v"].to_pylist(), np.float64) @ np.array(right["v"].to_pylist(), np.float64).T
        i, j = np.nonzero(sim >= least - 1e-5)  # cut by the rounded value afterwards
        x, y = ka.take(pa.array(i)), kc.take(pa.array(j))
        if left["i"][0].as_py() == left["j"][0].as_py():
            ok = pc.less(x, y)  # a block with itself has each pair twice
            x, y, i, j = x.filter(ok), y.filter(ok), i[ok.to_numpy(zero_copy_only=False)], j[ok.to_numpy(zero_copy_only=False)]
        turn = pc.less(x, y)
        return pa.table({"s": pa.array([left["s"][0].as_py()] * len(x), left["s"].type), "a": pc.if_else(turn, x, y), "b": pc.if_else(turn, y, x), "similarity": pa.array(sim[i, j])})

    got = one.cogroup(two).applyInArrow(product, f"s {kinds[within]}, a {kinds[key]}, b {kinds[key]}, similarity double")
    return got.select(F.col("s").alias(within), "a", "b", F.round("similarity", 6).alias("similarity")).where(F.col("similarity") >= least)


def band(similarity: Column, edges: list[float]) -> Column:
    """JN13: name of the half-open band, null outside all."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:]):
        out = F.when((similarity >= lo) & (similarity < hi), f"{lo:.2f}-{hi:.2f}").otherwise(out)
    return out


def attach_labels(pairs: DataFrame, labels: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """JN22: (pairs with the label columns of their key, keys without a label). Label columns that the pairs already have
    are replaced, so a pair without a label keeps none. Of repeated labels none is chosen here: keys are unique."""
    bare = pairs.drop(*[c for c in labels.columns if c != key])
    return bare.join(labels, key, "left"), pairs.select(key).join(labels.select(key), key, "left_anti")
