"""Profiles and counts (AG1 to AG30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def value_counts(df: DataFrame, key: Column, name: str = "value") -> DataFrame:
    """AG1: (value, n, share in percent). The total is the sum over the counted values, so the table is read once; the
    window runs over the counts, which are combined before they meet."""
    n = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 0
    return n.withColumn("share", F.round(F.col("n") * 100.0 / F.lit(float(total or 1)), 4))


def duplicate_report(df: DataFrame, key: Column) -> DataFrame:
    """AG2: one row (unique_values, values_with_dup, rows_in_dup, extra_rows)."""
    n = df.groupBy(key.alias("v")).agg(F.count("*").alias("n"))
    dup = F.col("n") > 1
    return n.agg(F.count("*").alias("unique_values"), F.count_if(dup).alias("values_with_dup"), F.coalesce(F.sum(F.when(dup, F.col("n"))), F.lit(0)).alias("rows_in_dup"), F.coalesce(F.sum(F.when(dup, F.col("n") - 1)), F.lit(0)).alias("extra_rows"))


def percentiles(df: DataFrame, by: list[str], c: Column, at: tuple[float, ...] = (0.5, 0.9, 0.99), over: float | None = None) -> DataFrame:
    """AG3 to AG5: exact linear percentiles, minimum, maximum and mean; with ``over`` the number of values at least that."""
    names = ["p" + str(int(p * 100)) for p in at]
    aggs = [F.percentile(c, p).alias(n) for p, n in zip(at, names)] + ([] if over is None else [F.count_if(c >= over).alias("n_over")])
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most"), F.round(F.avg(c), 6).alias("mean"), *aggs)


def item_counts(df: DataFrame, items: Column, name: str = "item") -> DataFrame:
    """AG6, AG12, AG28: occurrences of the items of an array column."""
    return df.select(F.explode(items).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def top_k(counts: DataFrame, k: int, name: str = "value") -> DataFrame:
    """AG7: the k largest counts, ties by value."""
    return counts.orderBy(F.desc("n"), F.asc_nulls_first(name)).limit(k)


def group_stats(df: DataFrame, stratum: str, group: str) -> DataFrame:
    """AG8: rows, groups, largest group, its share, singletons and near_collapse by stratum."""
    g = df.groupBy(stratum, group).agg(F.count("*").alias("n"))
    out = g.groupBy(stratum).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"))
    share = F.col("largest") / F.col("n_rows")
    return out.withColumn("share", F.round(share, 4)).withColumn("near_collapse", share >= 0.5)


def linkage_summary(stats: DataFrame) -> DataFrame:
    """AG9: totals over the rows of group_stats."""
    return stats.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_groups").alias("n_groups"), F.max("largest").alias("largest"), F.count_if("near_collapse").alias("near_strata"))


def confusion_at(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """AG10: tp, fp, fn, tn, precision and recall at each threshold, null where nothing is to divide by."""
    t = df.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    hit = F.col(score) >= F.col("threshold")
    # the list of thresholds is a parameter, so each row meets a handful of them
    x = df.select(score, label, F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")) if thresholds else df.crossJoin(t).limit(0)
    c = x.groupBy("threshold").agg(F.count_if(hit & F.col(label)).alias("tp"), F.count_if(hit & ~F.col(label)).alias("fp"), F.count_if(~hit & F.col(label)).alias("fn"), F.count_if(~hit & ~F.col(label)).alias("tn"))
    return c.withColumn("precision", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6))


def pick_threshold(table: DataFrame) -> DataFrame:
    """AG11: (threshold, rule): the lowest threshold without false positives, some pair above it and at least half of those
    below labelled different; else the lowest without false positives; else the highest that keeps any pair; else the highest."""
    below, above = F.col("fn") + F.col("tn"), F.col("tp") + F.col("fp")
    clean = (F.col("fp") == 0) & (above > 0)
    mostly = clean & ((below == 0) | (F.col("tn") * 2 >= below))
    lowest = lambda c: F.min(F.when(c, F.col("threshold")))
    some = F.max(F.when(above > 0, F.col("threshold")))
    rule = F.when(lowest(mostly).isNotNull(), "clean_and_mostly_different_below").when(lowest(clean).isNotNull(), "clean").otherwise("most_conservative")
    return table.agg(F.coalesce(lowest(mostly), lowest(clean), some, F.max("threshold")).alias("threshold"), rule.alias("rule"))


def capped_accounting(pool: DataFrame, capped: DataFrame, stratum: str, synthetic: Column) -> DataFrame:
    """AG14: (stratum, pool, pool_synthetic, capped, capped_synthetic): rows before and after a cap."""
    one = lambda df, k: df.select(F.col(stratum), *[F.lit(int(x == k)).alias(x) for x in ("pool", "capped")], F.coalesce(synthetic, F.lit(False)).cast("int").alias("s"))
    x = one(pool, "pool").unionByName(one(capped, "capped"))
    return x.groupBy(stratum).agg(F.sum("pool").alias("pool"), F.sum(F.col("pool") * F.col("s")).alias("pool_synthetic"), F.sum("capped").alias("capped"), F.sum(F.col("capped") * F.col("s")).alias("capped_synthetic"))


def paired_summary(pairs: DataFrame, low: Column, base_critical: Column, tuned_critical: Column) -> DataFrame:
    """AG18: (n, base_rate, tuned_rate, points, win, tie, loss, base_critical, tuned_critical, verdict). low: the lower end of
    the interval of the difference."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    x = pairs.agg(F.count("*").alias("n"), rate("base_pass").alias("b"), rate("tuned_pass").alias("t"), *[F.count_if(F.col("preferred") == p).alias(n) for p, n in (("tuned", "win"), ("tie", "tie"), ("base", "loss"))], F.count_if(base_critical).alias("base_critical"), F.count_if(tuned_critical).alias("tuned_critical"))
    points = (F.col("t") - F.col("b")) * 100
    made = verdict(points, low, F.col("tuned_critical") > F.col("base_critical"))
    return x.select("n", F.round("b", 6).alias("base_rate"), F.round("t", 6).alias("tuned_rate"), F.round(points, 6).alias("points"), "win", "tie", "loss", "base_critical", "tuned_critical", made.alias("verdict"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """AG13, AG14: counts by row, a column per value."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def first_per_key(df: DataFrame, key: str, prefer: Column, order: str) -> DataFrame:
    """AG29: one row per key: a preferred one if there is any, the first by order otherwise."""
    s = F.min_by(F.struct(*df.columns), F.struct((~prefer).alias("late"), F.col(order)))
    return df.groupBy(F.col(key).alias("_k")).agg(s.alias("s")).select("s.*")


def paired_breakdown(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """AG17, AG18, AG20, AG22: passes by side and difference in points, overall and by each field, in one pass over
    grouping sets. pairs: base_pass, tuned_pass, preferred and the fields."""
    parts = [F.struct(F.lit("all").alias("field"), F.lit("all").alias("value"))] + [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in fields]
    x = pairs.select("base_pass", "tuned_pass", F.explode(F.array(*parts)).alias("k")).select("base_pass", "tuned_pass", "k.*")
    out = x.groupBy("field", "value").agg(F.count("*").alias("n"), F.count_if("base_pass").alias("base_passes"), F.count_if("tuned_pass").alias("tuned_passes"))
    return out.withColumn("points", F.round((F.col("tuned_passes") - F.col("base_passes")) * 100.0 / F.col("n"), 6))


def verdict(points: Column, low: Column, worse: Column) -> Column:
    """AG18: positive, negative or inconclusive."""
    return F.when((points >= 5) & (low > 0) & ~worse, "positive").when((points < 0) | worse, "negative").otherwise("inconclusive")


def macro_summary(pairs: DataFrame, stratum: str) -> DataFrame:
    """AG19: mean over strata of the stratum means, outcomes and preferences."""
    s = pairs.groupBy(stratum).agg(F.avg(F.col("base_pass").cast("double")).alias("b"), F.avg(F.col("tuned_pass").cast("double")).alias("t"), F.count_if(F.col("tuned_pass") & ~F.col("base_pass")).alias("gains"), F.count_if(~F.col("tuned_pass") & F.col("base_pass")).alias("losses"), F.count("*").alias("n"))
    return s.agg(F.count("*").alias("strata"), F.round(F.avg("b") * 100, 6).alias("base_macro"), F.round(F.avg("t") * 100, 6).alias("tuned_macro"), F.round((F.avg("t") - F.avg("b")) * 100, 6).alias("points"), F.sum("gains").alias("gains"), F.sum("losses").alias("losses"), F.sum(F.col("n") - F.col("gains") - F.col("losses")).alias("ties"))


def missing_bounds(pairs: DataFrame, observed: Column) -> DataFrame:
    """AG21: the difference in points if all missing rows favoured one side or the other."""
    o, m = observed, ~observed
    d = F.sum(F.when(o, F.col("tuned_pass").cast("int") - F.col("base_pass").cast("int")).otherwise(0))
    return pairs.agg(F.count("*").alias("n"), F.count_if(m).alias("missing"), F.round((d - F.count_if(m)) * 100.0 / F.count("*"), 6).alias("worst"), F.round((d + F.count_if(m)) * 100.0 / F.count("*"), 6).alias("best"))


def concentration(df: DataFrame, gram: Column, stratum: str, share: float = 0.1, strata: int = 5) -> DataFrame:
    """Grams of an array column in more than a share of the rows or in more than so many strata."""
    n = df.count()
    x = df.select(F.col(stratum), F.explode(F.array_distinct(gram)).alias("gram"))
    c = x.groupBy("gram").agg(F.count("*").alias("n_rows"), F.count_distinct(stratum).alias("n_strata"))
    return c.where((F.col("n_rows") > share * n) | (F.col("n_strata") > strata)).withColumn("row_share", F.round(F.col("n_rows") / n, 6))


def closer_audit(df: DataFrame, answer: Column, stratum: str, share: float = 0.1, strata: int = 5, kind_share: float = 0.6) -> DataFrame:
    """AG23: the breaches (kind, what, n_rows, n_strata): closing sentences and their 6-grams (one gram of all words where there
    are fewer) in more than a share of all rows or in more than so many strata, and kinds of closing in more than
    ``kind_share`` of the rows. No row means not concentrated. A row's keys are exploded and combined before the shuffle."""
    from corpusloom.functions import text as X
    from corpusloom.operators.rules import last_sentence, sentence_kinds

    n = df.count()
    x = df.select(F.coalesce(F.col(stratum), F.lit("?")).alias("s"), last_sentence(F.coalesce(answer, F.lit(""))).alias("c"))
    x = x.select("s", "c", X.closing_form(F.col("c")).alias("f")).where("f <> ''").select("s", "c", "f", F.split("f", " ").alias("w"))
    named = lambda kind, a: F.transform(a, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("what")))
    keys = F.concat(named("sentence", F.array("f")), named("6-gram", X.ngrams(F.col("w"), 6, short=True)), named("kind", sentence_kinds(F.col("c"))))
    c = x.select("s", F.explode(keys).alias("k")).groupBy("k.kind", "k.what").agg(F.count("*").alias("n_rows"), F.count_distinct("s").alias("n_strata"))
    wide = (F.col("kind") != "kind") & ((F.col("n_rows") > share * n) | (F.col("n_strata") > strata))
    return c.where(wide | ((F.col("kind") == "kind") & (F.col("n_rows") > kind_share * n)))


def latency_summary(df: DataFrame, by: list[str], latency: str, tokens: str, failed: Column) -> DataFrame:
    """AG24: attempts, failures, percentiles of the successes, rates over the summed time."""
    ok = F.when(~failed, F.col(latency))
    wall = F.sum(latency) / 1000.0
    return df.groupBy(*by).agg(F.count("*").alias("attempts"), F.count_if(failed).alias("failures"), F.round(F.percentile(ok, 0.5), 4).alias("p50"), F.round(F.percentile(ok, 0.95), 4).alias("p95"), F.round(F.try_divide(F.count("*"), wall), 6).alias("per_second"), F.round(F.try_divide(F.sum(tokens), wall), 4).alias("tokens_per_second"))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """AG26: mean weighted by tokens, null without weight."""
    return df.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))), 6).alias("mean"))


def reserve_or_usage(df: DataFrame, by: list[str], usage: str, reserve: str) -> DataFrame:
    """AG30: sum of the usage, or of the reserve where none is known."""
    return df.groupBy(*by).agg(F.round(F.sum(F.coalesce(usage, reserve)), 4).alias("total"))


def batches(df: DataFrame, order: Column, size: int) -> DataFrame:
    """Row number in a total order, in batches. Numbers are given per range of the order and offset by the sizes of the
    ranges before, so no single task sorts the table."""
    spark = df.sparkSession
    x = df.withColumn("_o", order)
    parts = spark.sparkContext.defaultParallelism
    ranged = x.repartitionByRange(parts, "_o").withColumn("_p", F.spark_partition_id())
    from corpusloom.session import materialize

    ranged = materialize(ranged)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row per range
    out = ranged.join(F.broadcast(sizes.select("_p", "base")), "_p").withColumn("position", F.col("base") + F.row_number().over(W.partitionBy("_p").orderBy("_o")) - 1)
    return out.withColumn("batch", F.expr(f"position div {size}")).drop("_o", "_p", "base")


def phrase_hits(df: DataFrame, flags: dict[str, Column], phrases: Column) -> DataFrame:
    """AG15: (kind, name, n): rows, rows with each flag, and rows with each phrase of an array column."""
    one = df.select(F.array(F.struct(F.lit("rows").alias("kind"), F.lit("").alias("name"), F.lit(True).alias("hit")), *[F.struct(F.lit("flag").alias("kind"), F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("hit")) for k, v in flags.items()]).alias("f"), phrases.alias("p"))
    said = F.transform(F.coalesce(F.array_distinct("p"), F.array().cast("array<string>")), lambda x: F.struct(F.lit("phrase").alias("kind"), x.alias("name"), F.lit(True).alias("hit")))
    return one.select(F.explode(F.concat("f", said)).alias("x")).groupBy("x.kind", "x.name").agg(F.count_if("x.hit").alias("n"))


def score_summary(df: DataFrame, stratum: str, group: str, values: list[str], rates: list[str]) -> DataFrame:
    """AG16: over all rows (is_total) and per stratum: rows, distinct groups, mean and exact median of each value, rate of
    each flag; 0 for a value that no row has, as the reference's empty list. Nulls of flags count as false."""
    aggs = [F.count("*").alias("n"), F.countDistinct(group).alias("n_groups")]
    for v in values:
        aggs += [F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{v}_mean"), F.coalesce(F.percentile(v, F.lit(0.5)), F.lit(0.0)).alias(f"{v}_median")]
    aggs += [F.coalesce(F.avg(F.coalesce(F.col(r), F.lit(False)).cast("int")), F.lit(0.0)).alias(f"{r}_rate") for r in rates]
    total = df.groupBy().agg(*aggs).select(F.lit(True).alias("is_total"), F.lit(None).cast(dict(df.dtypes)[stratum]).alias(stratum), "*")
    return total.unionByName(df.groupBy(stratum).agg(*aggs).select(F.lit(False).alias("is_total"), "*"))
