"""Whole pipelines from the operators: corpus to frozen splits, leakage screen, paired evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import grouping, joins, rules, selection
from corpusloom.session import materialize


def prepare(df: DataFrame, seed: str = "42", cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept rows with group_new and split_new, rejected rows with their reason). Keys come from the raw texts, as the
    cleaning must not change what counts as the same."""
    c = materialize(rules.clean(df).withColumns({"norm": X.normalize_ascii(F.coalesce("instruction", F.lit(""))), "template": X.response_template(F.coalesce("response", F.lit("")))}))
    bad = c.where("reject_id is not null or over_length").select("id", F.coalesce("reject_id", F.lit("over_length")).alias("reason"))
    kept = c.where("reject_id is null and not over_length")
    edges = grouping.star_edges(kept, "id", F.col("norm"), "intent").unionByName(grouping.star_edges(kept, "id", F.col("template"), "intent"))
    grouped = materialize(grouping.group_ids(grouping.with_groups(kept, "id", edges), "intent"))
    split = selection.split_groups(grouped, "intent", "group_new", seed).select(F.col("group_new").alias("_g"), "split_new")
    out = grouped.join(split, F.col("group_new") == F.col("_g")).drop("_g")  # group ids are unique over intents
    if cap:
        train = selection.cap_groups(out.where("split_new = 'train'"), "intent", "group_new", cap, seed)
        out = train.unionByName(out.where("split_new <> 'train'"))
    return out, bad


def audit(prepared: DataFrame) -> DataFrame:
    """(check, n): what must be zero after prepare()."""
    cross = joins.split_intersections(prepared, F.when(F.col("norm") != "", F.concat_ws(":", "intent", "norm")), "split_new").agg(F.coalesce(F.sum("n_values"), F.lit(0)).alias("n"))
    straddle = joins.straddling_groups(prepared, F.col("group_new"), "split_new").agg(F.count("*").alias("n"))
    slots = prepared.where(F.concat_ws("\n", "clean_instruction", "clean_response").contains("{{")).agg(F.count("*").alias("n"))
    out = None
    for name, x in (("shared_instructions", cross), ("straddling_groups", straddle), ("slots_left", slots)):
        y = x.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n"))
        out = y if out is None else out.unionByName(y)
    return out


def paired_answers(answers: DataFrame, items: DataFrame) -> DataFrame:
    """(id, intent, kind, base_pass, tuned_pass, preferred) from the newest answer of each side: here an answer passes if
    it is complete. Two aggregates over the answers; the hot item shrinks to two rows before it meets the items."""
    ok = F.col("answer").isNotNull() & (F.trim("answer") != "") & ~F.coalesce(F.col("truncated"), F.lit(False)) & F.col("error").isNull()
    last = answers.where("model in ('base', 'tuned') and id is not null").groupBy("id", "model").agg(F.max_by(ok, "answer_id").alias("ok"))
    per = last.groupBy("id").agg(F.max(F.when(F.col("model") == "base", F.col("ok"))).alias("base_pass"), F.max(F.when(F.col("model") == "tuned", F.col("ok"))).alias("tuned_pass"))
    x = items.select("id", "intent", "kind").join(per, "id", "left")
    b, t = F.coalesce("base_pass", F.lit(False)), F.coalesce("tuned_pass", F.lit(False))
    return x.select("id", "intent", "kind", b.alias("base_pass"), t.alias("tuned_pass"), (F.col("base_pass").isNotNull() & F.col("tuned_pass").isNotNull()).alias("observed"), F.when(b & ~t, "base").when(t & ~b, "tuned").otherwise("tie").alias("preferred"))


def unblind(sheet: DataFrame, key: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN5, PRJ17: (id, model, pass) from an A/B sheet and its key, and violations where an answer is not the sealed one."""
    x = sheet.join(key, "item_id")
    bad = x.where((F.sha2("answer_A", 256) != F.col("sha_A")) | (F.sha2("answer_B", 256) != F.col("sha_B"))).select("item_id")
    long = x.select("item_id", F.explode(F.array(F.struct(F.col("model_A").alias("model"), F.col("pass_A").alias("pass")), F.struct(F.col("model_B").alias("model"), F.col("pass_B").alias("pass")))).alias("s"))
    return long.select("item_id", "s.model", X.parse_bool(F.col("s.pass"), strict=True).alias("pass")), bad
