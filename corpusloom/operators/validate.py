"""Constraints (VA1 to VA21): each gives violations (rule_id, row_key, detail) instead of stopping; fail_fast() stops.

Row rules compile to one array of rule ids per row, so a table is read once for all of them; set rules are aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """rules: {rule id: condition that must not hold}. A null condition holds no violation."""
    hits = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(hits).alias("rule_id"), F.col(key).cast("string").alias("row_key"), F.lit("").alias("detail"))


def repeated(df: DataFrame, key: str, rule: str = "repeated_id") -> DataFrame:
    n = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return n.select(F.lit(rule).alias("rule_id"), F.col(key).cast("string").alias("row_key"), F.col("n").cast("string").alias("detail"))


def missing_columns(df: DataFrame, wanted: dict[str, str]) -> list[tuple[str, str]]:
    """(rule, column) for columns that lack or have another type; a check of the schema, no job."""
    have = dict(df.dtypes)
    return [("missing_column", c) for c in wanted if c not in have] + [("wrong_type", c) for c, t in wanted.items() if c in have and have[c] != t]


def coverage(df: DataFrame, key: Column, expected: DataFrame, rule: str = "not_covered") -> DataFrame:
    """VA4, VA9, VA13: expected values that do not occur."""
    e = expected.toDF("e")
    return e.join(df.select(key.alias("e")).distinct(), "e", "left_anti").select(F.lit(rule).alias("rule_id"), F.col("e").cast("string").alias("row_key"), F.lit("").alias("detail"))


def quota_per(df: DataFrame, by: list[str], n: int, rule: str = "quota") -> DataFrame:
    """VA1, VA6: groups whose number of rows is not n."""
    g = df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") != n)
    return g.select(F.lit(rule).alias("rule_id"), F.concat_ws("/", *by).alias("row_key"), F.col("n").cast("string").alias("detail"))


def scenario_rules() -> dict[str, Column]:
    """VA1, VA2, VA3 for evaluation items."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    texts = lambda c: F.coalesce(F.size(c) < 1, F.lit(True)) | F.exists(c, lambda x: x.isNull() | (F.trim(x) == ""))
    cosine = F.col("max_bitext_cosine")
    from corpusloom.operators.rules import has_control_marks

    return {
        "id_form": ~F.coalesce(F.col("id").rlike(r"^(?:ch2|ch)-\d{3}$"), F.lit(False)), "kind": ~F.coalesce(F.col("kind").isin("ordinary", "hard"), F.lit(False)),
        "query_blank": blank("query"), "facts_blank": blank("facts"), "actions": texts("acceptable_actions"), "critical": texts("critical_fail_if"),
        "cosine_range": cosine.isNull() | F.isnan(cosine) | ~cosine.between(0, 1), "cosine_cap": cosine >= 0.85, "demo": ~F.coalesce(F.col("demo") == F.lit(False), F.lit(False)),
        "control_mark": has_control_marks(F.concat_ws("\n", "query", "facts")),
    }


def split_manifest(df: DataFrame, split: str, group: str, key: str) -> DataFrame:
    """VA8: (split, n_rows, n_groups, digest) of frozen splits: the digest sums the hashes of the keys with their groups, so it
    depends on no order of rows and is combined before the shuffle."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.coalesce(F.col(group).cast("string"), F.lit(""))), 256), 1, 12), 16, 10).cast("long")
    return df.groupBy(split).agg(F.count("*").alias("n_rows"), F.count_distinct(group).alias("n_groups"), F.sum(h % 1_000_000_007).alias("digest"))


def judgment_rules(passed: str, critical: str, credential: str | None = None) -> dict[str, Column]:
    """VA6: a pass is neither critical nor a credential violation, and the latter is critical."""
    out = {"pass_with_critical": F.col(passed) & F.col(critical)}
    if credential:
        out |= {"pass_with_credential": F.col(passed) & F.col(credential), "credential_not_critical": F.col(credential) & ~F.col(critical)}
    return out


def training_rules(max_tokens: int = 512) -> dict[str, Column]:
    """VA8: what no training row may have."""
    return {"slot_left": F.concat_ws("\n", "instruction", "response").contains("{{"), "over_length": F.col("n_tokens") > max_tokens, "instruction_missing": F.col("instruction").isNull(), "response_missing": F.col("response").isNull()}


def journal_violations(events: DataFrame) -> DataFrame:
    """VA18, for events (item_id, attempt, event, status): attempts are contiguous from 1, each started once and finished
    at most once, none after a valid one. One aggregate per item; an item's attempts are few."""
    a = events.groupBy("item_id", "attempt").agg(F.count_if(F.col("event") == "started").alias("s"), F.count_if(F.col("event") == "finished").alias("f"), F.max(F.when(F.col("event") == "finished", F.col("status"))).alias("status"))
    per = a.groupBy("item_id").agg(F.count("*").alias("n"), F.max("attempt").alias("last"), F.count_if((F.col("s") != 1) | (F.col("f") > 1) | (F.col("f") > F.col("s"))).alias("unpaired"), F.min(F.when(F.col("status") == "valid", F.col("attempt"))).alias("valid_at"), F.count_if(F.col("status").isNotNull() & ~F.col("status").isin("valid", "invalid", "transport_error")).alias("odd"))
    rules = {"attempts_not_contiguous": F.col("n") != F.col("last"), "unpaired_event": F.col("unpaired") > 0, "graded_after_valid": F.col("last") > F.col("valid_at"), "unknown_status": F.col("odd") > 0}
    return row_violations(per, "item_id", rules)


def series_rules(limit: float) -> dict[str, Column]:
    """VA14: finite values under a limit."""
    v = F.col("value")
    return {"missing": v.isNull(), "not_finite": F.isnan(v) | (F.abs(v) == float("inf")), "over_limit": v >= limit}


def fail_fast(violations: DataFrame, show: int = 5) -> None:
    bad = violations.limit(show).collect()
    if bad:
        raise ValueError("violations: " + "; ".join(f"{r.rule_id} {r.row_key} {r.detail}".strip() for r in bad))
