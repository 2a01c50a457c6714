"""Registered queries of the training-data operators and, where SQL can express them over whole tables, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import answers, leak, mixture, pairs, residue, splits, unify
from corpusloom.session import table


def p1_found(spark, d):
    return answers.answer_defects(table(spark, d, "raw_answers"), table(spark, d, "scenarios"))


def p1_labels(spark, d):
    got = answers.answer_labels(table(spark, d, "raw_answers"), table(spark, d, "scenarios"))
    return got.withColumn("posterior", F.round("posterior", 4))


def p3_found(spark, d):
    return answers.truncated_answers(table(spark, d, "raw_answers"), table(spark, d, "scenarios"))


def p3_rates(spark, d):
    return answers.truncation_rates(table(spark, d, "raw_answers"), table(spark, d, "scenarios"))


def p7_found(spark, d):
    return leak.leaked_pairs(table(spark, d, "documents"), table(spark, d, "scenarios"))


def p7_items(spark, d):
    """(id, n_docs) for every scenario, 0 included."""
    found = p7_found(spark, d).groupBy("id").agg(F.count("*").alias("n_docs"))
    items = table(spark, d, "scenarios").select("id")
    return items.join(found, "id", "left").select("id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def p9_found(spark, d):
    return unify.look_pairs(table(spark, d, "documents"))


def p9_unified(spark, d):
    return table(spark, d, "documents").select("doc_id", unify.unified_udf("text").alias("text"))


def p9_classes(spark, d):
    return unify.look_classes(table(spark, d, "documents"))


def p2_found(spark, d):
    return residue.residue(table(spark, d, "augmentation_context"))


def p2_passages(spark, d):
    """The strongest passage of each text, with its log odds."""
    return residue.scored(table(spark, d, "augmentation_context")).withColumn("log_odds", F.round("log_odds", 3))


def p4_found(spark, d):
    return pairs.split_overlaps(table(spark, d, "augmentation_context"))


def p4_report(spark, d):
    t = table(spark, d, "augmentation_context")
    return pairs.overlap_report(t, pairs.overlap_links(t))


def p4_links(spark, d):
    return pairs.overlap_links(table(spark, d, "augmentation_context"))


def p5_found(spark, d):
    return splits.related_sets(table(spark, d, "augmentation_context"))


def p5_assigned(spark, d):
    return splits.assign_splits(table(spark, d, "augmentation_context"))


def p5_balance(spark, d):
    t = table(spark, d, "augmentation_context")
    return splits.split_balance(t, splits.assign_splits(t))


def p6_found(spark, d):
    return pairs.near_duplicate_pairs(table(spark, d, "augmentation_context"))


def p6_groups(spark, d):
    return pairs.near_duplicate_groups(table(spark, d, "augmentation_context"))


def p8_mixture(spark, d):
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p8_shares(spark, d):
    targets = table(spark, d, "source_targets")
    return mixture.shares(mixture.mixture(table(spark, d, "documents"), targets), targets)


_ALL = (
    p1_found, p1_labels, p2_found, p2_passages, p3_found, p3_rates, p4_found, p4_report, p4_links, p5_found, p5_assigned, p5_balance,
    p6_found, p6_groups, p7_found, p7_items, p8_mixture, p8_shares, p9_found, p9_unified, p9_classes,
)
QUERIES = {f.__name__: f for f in _ALL}
_NUMBER = "regexp_replace(regexp_replace(group_id, '[^0-9]', '', 'g'), '^0+(.)', '\\1')"
_WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))"
_OVER = "len(list_intersect(a.w, b.w)) >= {t} * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9"
_BOTH = "concat_ws(chr(10), instruction, response)"
_SPLIT = "case when lower(split) = 'train' then 'train' when lower(split) = 'test' then 'test' when lower(split) in ('val', 'validation') then 'val' end"
_RECORDS = f"select id, target_source, {_SPLIT} s, nullif({_NUMBER}, '') g, coalesce({_WORDS.format('instruction')}, []) w from augmentation_context where id is not null"
_CROSS = f"""with x as (select *, s = 'train' tr from ({_RECORDS}) where s is not null),
p as materialized (select a.id t, b.id h from x a join x b on a.tr and not b.tr where coalesce(a.g = b.g, false) or (len(a.w) > 0 and least(len(a.w), len(b.w)) >= 0.85 * greatest(len(a.w), len(b.w)) - 1e-9 and {_OVER.format(t=0.85)}))"""
#: The form of a text that looks the same: ignorable characters go, blanks and line ends are one, then width, joined letters and
#: letters of other alphabets. Composed letters of those alphabets are listed with theirs.
_LOOK = (
    r"nfc_normalize(translate(nfc_normalize(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFF8}]', '', 'g'),"
    r" '\r\n|[\r\x0b\x0c\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '[\t\p{Zs}]', ' ', 'g'), 'ﬀ', 'ff', 'g'), 'ﬃ', 'ffi', 'g'), 'ﬄ', 'ffl', 'g'), 'ﬁ', 'fi', 'g'), 'ﬂ', 'fl', 'g'), "
    + "'" + "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "', '" + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "')), '" + unify.ALIKE_FROM + "ЁёЇї', '" + unify.ALIKE_TO + "ËëÏï'))"
)
_RUNS = "unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) g"
_LEAKS = (
    "with iw as (select id, regexp_extract_all(lower(" + _LOOK.replace("(text,", "(t,") + r"), '[\p{L}\p{N}]+') w from (select id, unnest([query, facts]) t from scenarios) where t is not null), ig as (select distinct id, " + _RUNS + " from iw where len(w) >= 12), "
    "dw as (select doc_id, regexp_extract_all(lower(" + _LOOK + r"), '[\p{L}\p{N}]+') w from documents where text is not null), dg as (select doc_id, " + _RUNS + " from dw where len(w) >= 12), f as (select distinct doc_id, id from dg join ig using (g)) "
)
SQL: dict[str, str] = {
    "p7_found": _LEAKS + "select doc_id, id from f",
    "p7_items": _LEAKS + "select s.id, count(f.doc_id) n_docs from scenarios s left join f on f.id = s.id group by s.id",
    "p4_found": f"""
with x as (select id, nullif({_NUMBER}, '') g, case when lower(split) = 'train' then 1 else 0 end tr, coalesce({_WORDS.format('instruction')}, []) w from augmentation_context where id is not null and split is not null)
select least(a.id, b.id) id_a, greatest(a.id, b.id) id_b from x a join x b on a.tr = 1 and b.tr = 0
where coalesce(a.g = b.g, false) or (len(a.w) > 0 and least(len(a.w), len(b.w)) >= 0.85 * greatest(len(a.w), len(b.w)) - 1e-9 and {_OVER.format(t=0.85)})""",
    "p4_links": f"""{_CROSS}, n as (select id, count(*) n from (select t id from p union all select h from p) group by 1), c as (select w2, min(id) c from (select id, list_sort(w) w2 from x where len(w) > 0) group by w2)
select x.id, x.tr train, coalesce(c.c, x.id) class_id, coalesce(n.n, 0) n_links from x left join c on list_sort(x.w) = c.w2 left join n on x.id = n.id where g is not null or len(w) > 0""",
    "p4_report": f"""{_CROSS} select x.s split, x.target_source, count(distinct p.h) n_records, count(*)::bigint n_pairs from p join x on x.id = p.h group by 1, 2""",
    "p5_found": f"""
with recursive x as (select id, nullif({_NUMBER}, '') g, case when regexp_matches(thread_ref, '[0-9]') then lower(trim(thread_ref)) end t from augmentation_context where id is not null),
e as (select distinct 'g' || g a, 't' || t b from x where g is not null and t is not null), u as (select a, b from e union select b, a from e),
r(n, m) as (select a, a from u union select u.b, r.m from r join u on r.n = u.a where r.m < u.b), k as (select n, min(m) m from r group by n),
o as (select m from k where n like 'g%' group by m having count(*) > 1),
y as (select x.id, coalesce(k1.m, k2.m) m from x left join k k1 on k1.n = 'g' || x.g left join k k2 on k2.n = 't' || x.t)
select id, min(id) over (partition by m) root_id from y where m in (select m from o)""",
    "p6_groups": f"""
with recursive x as (select id, {_WORDS.format(_BOTH)} w from augmentation_context where id is not null),
p as materialized (select a.id a, b.id b from x a join x b on a.id < b.id and len(a.w) > 0 and least(len(a.w), len(b.w)) >= 0.75 * greatest(len(a.w), len(b.w)) - 1e-9 where {_OVER.format(t=0.75)}),
u as materialized (select a, b from p union all select b, a from p), r(n, m) as (select id, id from x where len(w) > 0 union select u.b, r.m from r join u on r.n = u.a where r.m < u.b)
select r.n id, min(r.m) group_id, coalesce(max(k.n), 0) n_links from r left join (select a, count(*) n from u group by a) k on k.a = r.n group by r.n""",
    "p9_found": f"""with x as (select doc_id, text, {_LOOK} k from documents where text is not null) select least(a.doc_id, b.doc_id) doc_a, greatest(a.doc_id, b.doc_id) doc_b from x a join x b on a.k = b.k and a.doc_id < b.doc_id and a.text <> b.text""",
    "p9_classes": f"""with x as (select doc_id, text, {_LOOK} k from documents where text is not null) select doc_id, min(doc_id) over (partition by k) class_id, count(*) over (partition by k) n_docs, v.n n_variants from x join (select k, count(distinct text) n from x group by k) v using (k)""",
    "p9_unified": f"""select doc_id, {_LOOK} as text from documents""",
    "p6_found": f"""
with x as (select id, {_WORDS.format(_BOTH)} w from augmentation_context where id is not null)
select a.id id_a, b.id id_b from x a join x b on a.id < b.id and len(a.w) > 0 and least(len(a.w), len(b.w)) >= 0.75 * greatest(len(a.w), len(b.w)) - 1e-9 where {_OVER.format(t=0.75)}""",
}
