"""Planning, sheets, restored assignments and decoded responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick_from(seed: str, key: Column, choices: list[str]) -> Column:
    """PRJ28: a choice by the first byte of a digest."""
    n = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), key), 256), 1, 2), 16, 10).cast("int")
    return F.element_at(F.array(*map(F.lit, choices)), n % len(choices) + 1)


def style_plan(cells: DataFrame, n: int, first: str, others: list[str]) -> DataFrame:
    """PRJ29: n rows per cell: half of them (rounded down) of the first style, the others in turn."""
    i = F.col("slot")
    style = F.when(i < n // 2, F.lit(first)).otherwise(F.element_at(F.array(*map(F.lit, others)), (i - n // 2) % len(others) + 1))
    return cells.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("style", style)


def judgment_sheet(items: DataFrame, base: DataFrame, tuned: DataFrame, sides: DataFrame, missing: str = "[no answer]") -> DataFrame:
    """JN3, JN4, PRJ16: (id, answer_A, answer_B, pass_A, pass_B): both answers of each item by side; a failed answer stays
    in the table, with a text that says so and its pass preset to false. base, tuned: (id, answer), one row per id."""
    b, t = base.select("id", F.col("answer").alias("b")), tuned.select("id", F.col("answer").alias("t"))
    x = items.select("id").join(sides, "id").join(b, "id", "left").join(t, "id", "left")
    first = F.col("base_first")
    a_, b_ = F.when(first, F.col("b")).otherwise(F.col("t")), F.when(first, F.col("t")).otherwise(F.col("b"))
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    shown = lambda c: F.when(blank(c), F.lit(missing)).otherwise(c)
    preset = lambda c: F.when(blank(c), "false").otherwise("")
    return x.select("id", shown(a_).alias("answer_A"), shown(b_).alias("answer_B"), preset(a_).alias("pass_A"), preset(b_).alias("pass_B"))


def restore(df: DataFrame, frozen: DataFrame, key: str) -> DataFrame:
    """JN7: rows with their frozen assignment; rows without one are left out."""
    return df.join(frozen, key)


def reuse_verdicts(df: DataFrame, text: str, stratum: str, verdicts: DataFrame) -> DataFrame:
    """JN18: a verdict given before to the same text and stratum, by its hash; null where there is none."""
    return df.withColumn("text_hash", F.sha2(F.col(text), 256)).join(verdicts, ["text_hash", stratum], "left")


def compare_series(a: DataFrame, b: DataFrame, step: str, value: str, tolerance: float) -> DataFrame:
    """JN24: (steps, largest_difference, last_step, same)."""
    x = a.select(step, F.col(value).alias("a")).join(b.select(step, F.col(value).alias("b")), step)
    d = F.max(F.abs(F.col("a") - F.col("b")))
    return x.agg(F.count("*").alias("steps"), F.round(d, 6).alias("largest_difference"), F.max(step).alias("last_step"), (d <= tolerance).alias("same"))


def rubric(items: DataFrame) -> DataFrame:
    """PRJ36: what a grader sees of an item, lists joined, nulls as empty."""
    text = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "; ")
    return items.select("id", F.coalesce("facts", F.lit("")).alias("facts"), text("acceptable_actions").alias("actions"), text("critical_fail_if").alias("critical"))


def verdict_reasons(reasons: Column, allowed: list[str]) -> Column:
    """PRJ36: the allowed reasons among those given, distinct and sorted."""
    return F.array_sort(F.array_intersect(F.coalesce(reasons, F.array().cast("array<string>")), F.array(*map(F.lit, allowed))))


def decode_response(body: Column) -> dict[str, Column]:
    """PRJ35: the text of a completed response with exactly one message and no other item; null, with a problem, otherwise."""
    r = F.from_json(body, "status string, output array<struct<type: string, text: string>>")
    messages = F.filter(r["output"], lambda x: x["type"] == "message")
    problem = F.when(r.isNull() | r["status"].isNull(), "not_json").when(r["status"] != "completed", "not_completed").when(F.coalesce(F.size(messages), F.lit(0)) != 1, "messages").when(F.size(r["output"]) != 1, "other_items")
    return {"text": F.when(problem.isNull(), F.element_at(messages, 1)["text"]), "problem": problem}


def result_row(latency_ms: Column, tokens: Column, seconds: Column, answer: Column, error: Column, cap: int = 256) -> dict[str, Column]:
    """PRJ34: fields of a result row; a failed one has an empty answer and no tokens."""
    bad = error.isNotNull()
    return {"answer": F.when(bad, "").otherwise(answer), "gen_tokens": F.when(bad, 0).otherwise(tokens), "latency_ms": F.round(latency_ms, 3), "tokens_per_s": F.when(~bad, F.round(F.try_divide(tokens, seconds), 3)), "truncated": F.coalesce(~bad & (tokens >= cap), F.lit(False))}


def reason_counts(df: DataFrame, stratum: str, reasons: Column) -> DataFrame:
    """AG25, AG28: counts by stratum and reason."""
    return df.select(stratum, F.explode(reasons).alias("reason")).groupBy(stratum, "reason").agg(F.count("*").alias("n"))


def token_stats(df: DataFrame, by: list[str], tokens: str, target: str) -> DataFrame:
    """AG27."""
    return df.groupBy(*by).agg(F.min(tokens).alias("least"), F.max(tokens).alias("most"), F.count_distinct(target).alias("unique_targets"))
