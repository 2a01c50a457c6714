"""Audits of sheets, screenings, seals, manifests and published numbers: violations (rule_id, row_key, detail) like validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.validate import repeated, row_violations

_SHAPE = ("rule_id", "row_key", "detail")


def _one(df: DataFrame, rule: str, key: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(rule).alias("rule_id"), key.cast("string").alias("row_key"), (detail.cast("string") if detail is not None else F.lit("")).alias("detail"))


def _all(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*_SHAPE)
    for p in parts[1:]:
        out = out.unionByName(p.select(*_SHAPE))
    return out


def layout_violations(items: DataFrame, intents: DataFrame, per_intent: int, pattern: str = r"^([a-z0-9]+)-(\d{3})$") -> DataFrame:
    """VA1, VA4: number of rows, repeated ids, one id prefix, numbers without a gap, items per intent and kind, intents without
    items, and queries that are equal once folded. All checks are aggregates; nothing is ordered in one task."""
    x = items.select("id", "intent", "kind", F.regexp_extract("id", pattern, 1).alias("p"), F.regexp_extract("id", pattern, 2).cast("int").alias("i"), F.lower(F.trim("query")).alias("q"))
    total = x.agg(F.count("*").alias("n"), F.count_distinct("p").alias("prefixes"), (F.max("i") - F.min("i") + 1).alias("span"), F.count_distinct("i").alias("numbers"))
    want = intents.agg((F.count("*") * per_intent).alias("want"))
    size = total.join(want, F.lit(True)).where("n <> want")  # one row on either side
    cells = x.groupBy("intent", "kind").agg(F.count("*").alias("n")).where(F.col("n") * 2 != per_intent)
    lacking = intents.select("intent").join(x.select("intent").distinct(), "intent", "left_anti")
    same = x.where("q <> ''").groupBy("q").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    return _all(
        _one(size, "row_count", F.lit("all"), F.col("n")), repeated(items, "id"), _one(total.where("prefixes <> 1"), "prefixes", F.lit("all"), F.col("prefixes")),
        _one(total.where("span <> numbers"), "numbers_with_gaps", F.lit("all"), F.col("span") - F.col("numbers")), _one(cells, "cell_size", F.concat_ws("/", "intent", "kind"), F.col("n")),
        _one(lacking, "intent_without_items", F.col("intent")), _one(same, "same_query", F.col("least"), F.col("n")),
    )


def metric_violations(items: DataFrame, metrics: DataFrame, key: str = "id", cap: float = 0.85, against_cap: float = 0.80, tolerance: float = 1e-4) -> DataFrame:
    """VA2, VA5: metrics (key, bitext, against, six_gram_hits) recomputed for the items: cosines at or over their cap, stored
    values that the recomputation does not give, shared grams, items without metrics."""
    x = items.select(key, "max_bitext_cosine").join(metrics, key, "left")
    rules = {
        "no_metrics": F.col("six_gram_hits").isNull(), "bitext_cap": F.col("bitext") >= cap, "against_cap": F.col("against") >= against_cap,
        "stored_differs": F.abs(F.col("max_bitext_cosine") - F.round("bitext", 4)) > tolerance + 1e-12, "shared_grams": F.col("six_gram_hits") > 0,
    }
    return row_violations(x, key, rules)


def leak_verdict(screen: DataFrame, nearest: DataFrame, key: str, cap: float = 0.86) -> DataFrame:
    """VA5: (key, max_cosine, pass, reasons): a row passes if it shares no gram, equals no held-out text and its nearest cosine
    is below the cap. screen: (key, n_shared, exact), nearest: (key, similarity)."""
    x = screen.join(nearest.select(key, F.col("similarity").alias("max_cosine")), key, "left")
    why = F.filter(F.array(F.when(F.col("exact"), "exact"), F.when(F.col("n_shared") > 0, "shared_grams"), F.when(F.col("max_cosine") >= cap, "cosine")), lambda r: r.isNotNull())
    return x.select(key, "max_cosine", (F.size(why) == 0).alias("pass"), F.array_join(why, "|").alias("reasons"))


def sheet_violations(sheet: DataFrame, key: DataFrame, skipped: list[int]) -> DataFrame:
    """VA7: a partly filled sheet against its key. sheet: (item_id, question_number, immutable, judge_source, verdict, preferred);
    key: (item_id, immutable). Every item once, nothing immutable changed, declared skips blank and all there, valid choices."""
    x = sheet.join(key.select("item_id", F.col("immutable").alias("sealed")), "item_id", "left")
    skip = F.col("question_number").isin(*skipped) if skipped else F.lit(False)
    blank = F.coalesce(F.trim("verdict") == "", F.lit(True)) & F.coalesce(F.trim("preferred") == "", F.lit(True))
    rules = {
        "unknown_item": F.col("sealed").isNull(), "immutable_changed": F.col("immutable") != F.col("sealed"), "skip_not_blank": skip & ~(blank & (F.col("judge_source") == "missing")),
        "preference": ~skip & ~F.coalesce(F.col("preferred").isin("A", "B", "tie"), F.lit(False)), "verdict": ~skip & ~F.coalesce(F.col("verdict").isin("true", "false"), F.lit(False)),
    }
    lacking = key.select("item_id").join(sheet.select("item_id"), "item_id", "left_anti")
    declared = sheet.sparkSession.createDataFrame([(int(k),) for k in skipped], "question_number int")
    unused = declared.join(sheet.select(F.col("question_number").cast("int").alias("question_number")), "question_number", "left_anti")
    return _all(row_violations(x, "item_id", rules), repeated(sheet, "item_id"), _one(lacking, "missing_item", F.col("item_id")), _one(unused, "skip_without_row", F.col("question_number")))


def screening_violations(rows: DataFrame, results: DataFrame, key: str = "id", group: str = "group_id", cap: float = 0.86) -> DataFrame:
    """VA10: rows against the results (key, pass, max_cosine, n_shared) of their screening: the same ids, each id and group once,
    all passing, no cosine at or over the cap, no shared gram."""
    a, b = rows.select(key).distinct(), results.select(key).distinct()
    rules = {"failed": ~F.coalesce(F.col("pass"), F.lit(False)), "cosine": F.col("max_cosine") >= cap, "shared_grams": F.col("n_shared") > 0}
    return _all(
        _one(a.join(b, key, "left_anti"), "not_screened", F.col(key)), _one(b.join(a, key, "left_anti"), "unknown_result", F.col(key)),
        repeated(rows, key), repeated(rows.where(F.col(group).isNotNull()), group, "repeated_group"), row_violations(results, key, rules),
    )


def setting_violations(settings: DataFrame, required: dict[str, str]) -> DataFrame:
    """VA11: settings (key, value) against required keys and the pattern of their values. The required ones are a parameter."""
    want = settings.sparkSession.createDataFrame(sorted(required.items()), "key string, pattern string")
    x = want.join(settings.select("key", "value", F.lit(True).alias("there")), "key", "left")
    return _all(_one(x.where("there is null"), "missing_key", F.col("key")), _one(x.where("there and not coalesce(rlike(value, pattern), false)"), "value", F.col("key"), F.coalesce("value", F.lit("<null>"))))


def seal_violations(sealed: DataFrame, found: DataFrame, key: str, digest: str = "sha") -> DataFrame:
    """VA12, VA21: (key, digest) as sealed against what is found: entries missing, added or changed, and digests that are no
    64 hexadecimal digits. Nothing may be written or unblinded while a row is left."""
    x = sealed.select(key, F.col(digest).alias("a"), F.lit(True).alias("l")).join(found.select(key, F.col(digest).alias("b"), F.lit(True).alias("r")), key, "full_outer")
    rules = {
        "missing": F.col("r").isNull(), "added": F.col("l").isNull(), "changed": F.col("l") & F.col("r") & ~F.col("a").eqNullSafe(F.col("b")),
        "not_a_digest": F.col("l") & ~F.coalesce(F.col("a").rlike("^[0-9a-f]{64}$"), F.lit(False)),
    }
    return row_violations(x, key, rules)


def response_rules() -> dict[str, Column]:
    """VA16: what a measured response must have: an answer, positive whole token counts, finite positive times, a truncation
    state."""
    ok = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")) & ~F.isnan(F.col(c).cast("double")), F.lit(False))
    return {
        "answer": F.coalesce(F.trim("answer") == "", F.lit(True)), "prompt_tokens": ~F.coalesce(F.col("prompt_tokens") >= 1, F.lit(False)), "gen_tokens": ~F.coalesce(F.col("gen_tokens") >= 1, F.lit(False)),
        "latency_ms": ~ok("latency_ms"), "tokens_per_s": ~ok("tokens_per_s"), "truncated": F.col("truncated").isNull(),
    }


def block_violations(df: DataFrame, by: str, expected: int, failed: Column) -> DataFrame:
    """VA16: benchmark blocks without exactly the expected requests, or with failures."""
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(failed).alias("bad"))
    return _all(_one(g.where(F.col("n") != expected), "request_count", F.col(by), F.col("n")), _one(g.where("bad > 0"), "failures", F.col(by), F.col("bad")))


def replay_violations(published: DataFrame, computed: DataFrame, by: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """VA19: published summaries against recomputed ones: keys on one side only and values that differ."""
    key = F.concat_ws("/", *[F.coalesce(F.col(b).cast("string"), F.lit("")) for b in by])
    long = lambda df, side: df.select(key.alias("k"), F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("v")) for v in values])).alias("x")).select("k", "x.name", F.col("x.v").alias(side), F.lit(True).alias("has_" + side))
    x = long(published, "a").join(long(computed, "b"), ["k", "name"], "full_outer")
    off = F.col("has_a") & F.col("has_b") & ~(F.col("a").eqNullSafe(F.col("b")) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False)))
    name = F.col("name")
    return _all(_one(x.where("has_b is null"), "not_recomputed", F.col("k"), name), _one(x.where("has_a is null"), "not_published", F.col("k"), name), _one(x.where(off), "differs", F.col("k"), name))


def parity(left: DataFrame, right: DataFrame, key: str, tokens: str, text: str) -> DataFrame:
    """VA20: (key, n_tokens, tokens_match, text_match) of rows that both sides have; nulls match nulls."""
    x = left.select(key, F.col(tokens).alias("ta"), F.col(text).alias("a")).join(right.select(key, F.col(tokens).alias("tb"), F.col(text).alias("b")), key)
    return x.select(key, F.size("ta").cast("long").alias("n_tokens"), F.col("ta").eqNullSafe(F.col("tb")).alias("tokens_match"), F.col("a").eqNullSafe(F.col("b")).alias("text_match"))
