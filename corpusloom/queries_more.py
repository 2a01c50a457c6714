"""More registered queries: sources, sinks, audits, selection and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import sources, streaming
from corpusloom.functions import text as X
from corpusloom.operators import audits, grouping, joins, profile, rules, selection, sheets, stats, validate
from corpusloom.queries import _DOT, _INTENT_SQL, _PAIRED, _PAIRS, _SPLIT_SQL, SQL, _ans, _ctx, _intent, _items, _pairs, _split, _tokens, _vec, leak_sixgram_screen, paired_breakdown, query, split_groups_hash
from corpusloom.session import table
from corpusloom.sources import sinks

# --- sources and sinks ----------------------------------------------------------------------------------------------


@query("select id as source_id, 'row-' || lpad((row_number() over (order by id) - 1)::varchar, 6, '0') id from augmentation_context where id is not null")
def generated_ids(spark, d):
    x = _ctx(spark, d).where("id is not null").select(F.col("id").alias("source_id"))
    return sources.with_row_ids(x, "row-", ["source_id"]).select("source_id", "id")


@query("""with x as (select id, instruction, group_id from augmentation_context)
select 'blank_id' rule_id, '' row_key, '' detail from x where id is null or trim(id) = '' union all
select 'repeated_id', id, count(*)::varchar from x where trim(id) <> '' group by id having count(*) > 1 union all
select 'missing_query', coalesce(id, ''), '' from x where coalesce(trim(instruction) = '', true) union all
select 'invalid_group', coalesce(id, ''), '' from x where coalesce(trim(group_id) = '', true)""")
def comparison_violations(spark, d):
    return sources.comparison_rows(_ctx(spark, d))[1]


@query("""with u as (select 'answers' origin from raw_answers union all select 'items' from scenarios union all select 'records' from augmentation_context)
select e.origin, count(u.origin) n from (select unnest(['answers', 'items', 'records', 'tickets']) origin) e left join u on e.origin = u.origin group by 1""")
def union_source_counts(spark, d):
    named = {"answers": _ans(spark, d).select("id"), "items": _items(spark, d).select("id"), "records": _ctx(spark, d).select("id")}
    return sources.source_counts(sources.union_named(named), ["answers", "items", "records", "tickets"])


@query("select id, coalesce(answer, facts) as text from (select a.id, a.answer, s.facts from raw_answers a left join scenarios s on a.id = s.id) where coalesce(answer, facts) is not null")
def answer_or_response(spark, d):
    x = _ans(spark, d).join(_items(spark, d).select("id", "facts"), "id", "left").select("id", "answer", F.col("facts").alias("response"))
    return sources.answer_text(x).where("text is not null").select("id", "text")


@query("""select id, replace('{"id":' || to_json(id) || ',"intent":' || to_json(intent) || '}', '<', '\\u003c') as value from scenarios where id is not null and intent is not null""")
def html_safe_rows(spark, d):
    x = _items(spark, d).where("id is not null and intent is not null")
    return x.select("id", X.html_json(F.struct("id", "intent")).alias("value"))


@query("""select doc_id, part, 'part-' || lpad(part::varchar, 5, '0') as name, sha256(substr(text, part * 200 + 1, 200)) sha, sha256(text) total_sha
from (select doc_id, text, unnest(range(greatest(ceil(length(text) / 200.0), 1)::int))::int part from documents where text is not null)""")
def content_chunks(spark, d):
    return sinks.chunks(table(spark, d, "documents").where("text is not null"), "doc_id", "text", 200).drop("chunk")


@query("select doc_id, text as content, true intact from documents where text is not null")
def chunks_reassembled(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return sinks.reassembled(sinks.chunks(docs, "doc_id", "text", 200), "doc_id")


@query("select answer_id, lower((truncated)::varchar) truncated, lower((error is null)::varchar) ok from raw_answers where error is null")
def flat_grade_export(spark, d):
    x = _ans(spark, d).select(F.col("answer_id").alias("item_id"), F.when(F.col("error").isNull(), "valid").otherwise("failed").alias("status"), F.struct("truncated", F.col("error").isNull().alias("ok")).alias("grade"))
    return sinks.flat_grades(x).withColumnRenamed("item_id", "answer_id")


# --- rewrites -------------------------------------------------------------------------------------------------------


@query("""select answer_id, case lower(trim(w)) when 'true' then true when '1' then true when 'yes' then true when 'y' then true when 'false' then false when '0' then false when 'no' then false when 'n' then false end parsed,
case w when 'true' then true when 'false' then false end strict from (select answer_id, coalesce(truncated::varchar, ' Yes ') w from raw_answers)""")
def parsed_flags(spark, d):
    x = _ans(spark, d).select("answer_id", F.coalesce(F.col("truncated").cast("string"), F.lit(" Yes ")).alias("w"))
    return x.select("answer_id", X.parse_bool(F.col("w"), False).alias("parsed"), X.parse_bool(F.col("w"), True).alias("strict"))


@query("""select answer_id, case when error is not null then '' else answer end answer, case when error is not null then 0 else gen_tokens end gen_tokens, round(latency_ms, 3) latency_ms,
case when error is null and latency_ms <> 0 then round(gen_tokens / (latency_ms / 1000), 3) end tokens_per_s, coalesce(error is null and gen_tokens >= 256, false) truncated from raw_answers""")
def result_rows(spark, d):
    got = sheets.result_row(F.col("latency_ms"), F.col("gen_tokens"), F.col("latency_ms") / 1000, F.col("answer"), F.col("error"))
    return _ans(spark, d).select("answer_id", *[c.alias(k) for k, c in got.items()])


@query("""select answer_id, case when answer is null then 'messages' when error is not null then 'not_completed' end problem, case when error is null then answer end as text from raw_answers""")
def decoded_responses(spark, d):
    out = F.when(F.col("answer").isNull(), F.array().cast("array<struct<type:string,text:string>>")).otherwise(F.array(F.struct(F.lit("message").alias("type"), F.col("answer").alias("text"))))
    state = F.when(F.col("error").isNotNull() & F.col("answer").isNotNull(), "failed").otherwise("completed")
    body = F.to_json(F.struct(state.alias("status"), out.alias("output")))
    got = sheets.decode_response(body)
    return _ans(spark, d).select("answer_id", got["problem"].alias("problem"), got["text"].alias("text"))


@query("""select intent, array_to_string(list_sort(list_distinct(list_filter(cleaning, lambda r: r in ('collapse_whitespace', 'strip_slot')))), '|') reasons, id from augmentation_context where cleaning is not null""")
def allowed_reasons(spark, d):
    x = _ctx(spark, d).where("cleaning is not null")
    return x.select("intent", F.array_join(sheets.verdict_reasons(F.col("cleaning"), ["collapse_whitespace", "strip_slot"]), "|").alias("reasons"), "id")


@query("select id, list_transform(range(len(w)), lambda i: case when i >= 3 and i <= len(w) - 2 then w[i + 1] else 'masked' end) labels from (select id, " + _tokens("instruction") + " w from augmentation_context where instruction is not null)")
def label_masks(spark, d):
    x = _ctx(spark, d).where("instruction is not null").select("id", X.tokens(F.col("instruction")).alias("w"))
    kept = rules.label_mask(F.transform("w", lambda w, i: i), F.lit(3), F.size("w") - 2)
    return x.select("id", F.transform(kept, lambda i: F.when(i < 0, "masked").otherwise(F.get(F.col("w"), i))).alias("labels"))


@query("""with p as (select id, """ + _tokens("instruction") + """ w, (row_number() over (order by id) - 1) // 16 batch from augmentation_context where instruction is not null and id is not null)
select id, list_concat(w, list_transform(range(max(len(w)) over (partition by batch) - len(w)), lambda i: '<pad>')) padded from p""")
def padded_arrays(spark, d):
    x = _ctx(spark, d).where("instruction is not null and id is not null").select("id", X.tokens(F.col("instruction")).alias("w"))
    x = profile.batches(x, F.col("id"), 16)
    width = x.groupBy("batch").agg(F.max(F.size("w")).alias("n"))
    return x.join(width, "batch").select("id", F.concat("w", F.array_repeat(F.lit("<pad>"), F.col("n") - F.size("w"))).alias("padded"))


_ART = "(?i)\\b(?:your|my) (?:account type|delivery city|refund amount|order number|invoice number|order status)\\b"


@query(f"select count(*) filter (not coalesce(regexp_matches(response, '{_ART}'), false)) kept, count(*) filter (regexp_matches(response, '{_ART}')) excluded from augmentation_context")
def slot_wordings_excluded(spark, d):
    kept, out = rules.without_artifacts(_ctx(spark, d), "id", F.col("response"))
    return kept.agg(F.count("*").alias("kept")).join(out.agg(F.count("*").alias("excluded")), F.lit(True))


@query("""select doc_id, (regexp_matches(text, '(?i)pending|todo|fixme|tbd|placeholder') or trim(text) = '') unfinished, regexp_matches(text, '^(?i:https?)://[^/?#]+') is_url from documents where text is not null""")
def unfinished_values(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", rules.is_unfinished(F.col("text")).alias("unfinished"), rules.is_http_url(F.col("text")).alias("is_url"))


@query("""select answer_id, i::int line_number, trim(s, E' \\t') as line from (select answer_id, unnest(string_split(a, chr(10))) s, generate_subscripts(string_split(a, chr(10)), 1) i from (select answer_id, replace(answer, 'Kind regards', 'TODO regards') a from raw_answers where answer is not null)) where regexp_matches(s, '\\bTODO\\b|\\bFIXME\\b|\\[PENDING\\b')""")
def open_work_lines(spark, d):
    x = _ans(spark, d).where("answer is not null").select("answer_id", F.replace("answer", F.lit("Kind regards"), F.lit("TODO regards")).alias("a"))
    return rules.todo_lines(x, "answer_id", "a")


@query("select id, coalesce(response, '') || ' (checked)' response, response original_response, 'B' flags, 'review' target_source from augmentation_context")
def provenance_columns(spark, d):
    x = _ctx(spark, d).select("id", "response")
    return rules.with_provenance(x, F.concat(F.coalesce("response", F.lit("")), F.lit(" (checked)")), "B", "review").select("id", "response", "original_response", "flags", "target_source")


@query("""select a.action, not (trim(action) = '' or regexp_matches(action, '[0-9]') or regexp_matches(action, '(?i)https?://|www\\.|\\.com|\\.net|\\.org') or regexp_matches(action, '[@$£€₹]')
or regexp_matches(action, '(?i)\\b(?:one|two|three|four|five|six|seven|eight|nine|ten|dozen|several|few)\\s+(?:hours?|days?|minutes?|weeks?|months?|business)') or regexp_matches(action, '(?i)\\b(?:within|guarantee|policy|free of charge|no charge|refundable|24/7|always)\\b')) neutral
from (select distinct unnest(acceptable_actions) action from scenarios) a where action is not null""")
def neutral_phrases(spark, d):
    x = _items(spark, d).select(F.explode("acceptable_actions").alias("action")).where("action is not null").distinct()
    return x.select("action", rules.phrase_is_neutral(F.col("action")).alias("neutral"))


# --- joins ----------------------------------------------------------------------------------------------------------

_GRAMS = "list_distinct(list_transform(range(1, greatest(len(w) - 5, 0) + 1), lambda i: array_to_string(w[i:i + 5], ' ')))"


@query(f"""with c as (select id, unnest({_GRAMS}) gram from (select id, {_tokens('instruction')} w from augmentation_context)), h as (select id source, unnest({_GRAMS}) gram from (select id, {_tokens('query')} w from scenarios)),
n as (select gram, count(*) n_sources, array_to_string(list_sort(list(source order by source)[1:20]), ',') sources from h group by gram) select c.id, gram, n_sources, sources from c join n using (gram)""")
def shared_gram_sources(spark, d):
    return joins.gram_sources(_ctx(spark, d), "id", F.col("instruction"), _items(spark, d), "id", F.col("query"))


@query("""with b as (select id, max(tag) g from raw_answers where model = 'base' and id is not null group by id), t as (select id, max(tag) g from raw_answers where model = 'tuned' and id is not null group by id)
select id, b.g left_group, t.g right_group from b join t using (id) where b.g is distinct from t.g""")
def group_mismatches(spark, d):
    side = lambda m: _ans(spark, d).where(F.col("model") == m).where("id is not null").groupBy("id").agg(F.max("tag").alias("g"))
    return joins.group_mismatches(side("base"), side("tuned"), "id", "g")


@query(f"""select distinct i intent, 'unknown' problem from (select {_INTENT_SQL} i from augmentation_context) where i is not null and i not in (select intent from intents where category <> 'ORDER') union all
select intent, 'repeated' from intents where category <> 'ORDER' group by intent having count(*) > 1""")
def unknown_intents(spark, d):
    return joins.unknown_keys(_ctx(spark, d).select(_intent().alias("intent")), table(spark, d, "intents").where("category <> 'ORDER'"), "intent")


@query("select id, 'unknown' problem from (select distinct id from raw_answers where id is not null) where id not in (select id from scenarios) union all select id, 'repeated' from scenarios group by id having count(*) > 1")
def stale_answer_ids(spark, d):
    return joins.unknown_keys(_ans(spark, d).select("id"), _items(spark, d), "id")


@query(f"""select label, band, count(*) n from (select label, case when similarity >= 0.0 and similarity < 0.2 then '0.00-0.20' when similarity >= 0.2 and similarity < 1.0 then '0.20-1.00' end band, a, b from ({_PAIRS})) where band is not null group by 1, 2""")
def bands_by_label(spark, d):
    p = joins.similar_pairs(_vec(spark, d), "vec_id", "embedding", -1.0, "label")
    return p.withColumn("band", joins.band(F.col("similarity"), [0.0, 0.2, 1.0])).where("band is not null").groupBy("label", "band").agg(F.count("*").alias("n"))


_SEL = f"""with p as (select label, a row_a, b row_b, case when similarity >= 0.0 and similarity < 0.2 then '0.00-0.20' when similarity >= 0.2 and similarity < 1.0 then '0.20-1.00' end band from ({_PAIRS})),
x as (select *, md5('bp:' || band || ':' || row_a || ':' || row_b) h, least(row_a % 7, row_b % 7) t1, greatest(row_a % 7, row_b % 7) t2 from p where band is not null),
k1 as (select * from (select *, row_number() over (partition by label, band order by h, row_a, row_b) k from x) where k <= 5),
k2 as (select * from (select *, row_number() over (partition by band, t1, t2 order by h, row_a, row_b) k2 from k1) where k2 = 1),
k3 as (select *, row_number() over (partition by band, label order by h, row_a, row_b) k3 from k2),
s as (select *, row_number() over (partition by band order by k3, md5('bp:turn:' || band || ':' || label), label) place from k3)"""


@query(_SEL + " select label, band, row_a, row_b, place::int place from s where place <= case band when '0.00-0.20' then 12 else 8 end")
def banded_pair_sample(spark, d):
    p = joins.similar_pairs(_vec(spark, d), "vec_id", "embedding", -1.0, "label").withColumn("band", joins.band(F.col("similarity"), [0.0, 0.2, 1.0])).where("band is not null")
    p = p.select("label", "band", F.col("a").alias("row_a"), F.col("b").alias("row_b"))
    return selection.banded_pairs(p, "label", "band", F.col("row_a") % 7, F.col("row_b") % 7, {"0.00-0.20": 12, "0.20-1.00": 8}, "bp", 5).select("label", "band", "row_a", "row_b", "place")


@query(f"""with p as ({_PAIRS}) select p.a, p.b, l.label verdict, l.label is null unlabelled from p left join (select vec_id a, 'same' label from embeddings where vec_id % 3 = 0) l using (a) where p.similarity >= 0.3""")
def labelled_pairs(spark, d):
    p = joins.similar_pairs(_vec(spark, d), "vec_id", "embedding", 0.3, "label").select("a", "b")
    labels = _vec(spark, d).where("vec_id % 3 = 0").select(F.col("vec_id").alias("a"), F.lit("same").alias("verdict"))
    got, todo = joins.attach_labels(p, labels, "a")
    return got.join(todo.distinct().withColumn("u", F.lit(True)), "a", "left").select("a", "b", "verdict", F.coalesce("u", F.lit(False)).alias("unlabelled"))


@query(f"""with v as (select vec_id, label, embedding, case when vec_id % 5 = 0 then 'val' else 'train' end s from embeddings) select vec_id, nearest, similarity from (select a.vec_id, b.vec_id nearest, round({_DOT}, 6) similarity,
row_number() over (partition by a.vec_id order by round({_DOT}, 9) desc, b.vec_id) r from v a join v b on a.label = b.label and a.s = 'val' and b.s = 'train') where r = 1""")
def nearest_across_splits(spark, d):
    v = _vec(spark, d)
    return joins.nearest(v.where("vec_id % 5 = 0"), v.where("vec_id % 5 <> 0"), "vec_id", "embedding", within=F.col("label"))


@query("""with b as (select id, count(*) n, min((answer is not null and error is null)::int) ok from raw_answers where model = 'base' and id is not null group by id), x as (select s.id i, b.id j, b.n, b.ok from scenarios s full join b on s.id = b.id)
select coalesce(i, j) id, unnest(list_filter([case when j is null then 'base_missing' end, case when i is null then 'base_unknown' end, case when n > 1 then 'base_repeated' end, case when ok = 0 then 'base_failed' end], lambda p: p is not null)) problem from x""")
def pair_coverage(spark, d):
    a = _ans(spark, d).where("model = 'base' and id is not null").select("id", (F.col("answer").isNotNull() & F.col("error").isNull()).alias("ok"))
    return joins.coverage_violations(_items(spark, d), {"base": a}, "id")


# --- aggregates and statistics --------------------------------------------------------------------------------------


@query("""select lang, count(n_chars) n, min(n_chars)::double least, max(n_chars)::double most, round(avg(n_chars), 6) mean, quantile_cont(n_chars::double, 0.5) p50, quantile_cont(n_chars::double, 0.95) p95,
count(*) filter (n_chars >= 500) n_over from documents group by lang""")
def length_over_threshold(spark, d):
    return profile.percentiles(table(spark, d, "documents"), ["lang"], F.col("n_chars"), (0.5, 0.95), 500)


@query(f"""with g as ({SQL['split_groups_hash']}), p as (select c.intent, coalesce(c.flags = 'B', false) s, md5('cap:' || c.id) < '8' capped from augmentation_context c join g on c.group_id = g.group_id and c.intent is not distinct from g.intent where g.split_new = 'train')
select intent, count(*) pool, count(*) filter (s) pool_synthetic, count(*) filter (capped) capped, count(*) filter (capped and s) capped_synthetic from p group by intent""")
def capped_accounting(spark, d):
    g = split_groups_hash(spark, d).where("split_new = 'train'").select(F.coalesce("intent", F.lit("<null>")).alias("_s"), F.col("group_id").alias("_g"))
    pool = _ctx(spark, d).join(g, (F.coalesce("intent", F.lit("<null>")) == F.col("_s")) & (F.col("group_id") == F.col("_g")), "left_semi")
    return profile.capped_accounting(pool, pool.where(X.hash_order("cap", F.col("id")) < "8"), "intent", F.col("flags") == "B")


_HIT = {"sorry": "(?i)sorry|apolog", "cannot": "(?i)cannot|can't"}


@query("""with x as (select regexp_matches(answer, '(?i)sorry|apolog') s, regexp_matches(answer, '(?i)cannot|can''t') c, list_distinct(regexp_extract_all(lower(answer), 'kind regards|i cannot see')) p from raw_answers where answer is not null)
select 'rows' kind, '' as name, count(*) n from x union all select 'flag', 'sorry', count(*) filter (s) from x union all select 'flag', 'cannot', count(*) filter (c) from x union all select 'phrase', v, count(*) from (select unnest(p) v from x) group by v""")
def phrase_hit_counts(spark, d):
    a = _ans(spark, d).where("answer is not null")
    return profile.phrase_hits(a, {k: F.col("answer").rlike(p) for k, p in _HIT.items()}, F.regexp_extract_all(F.lower("answer"), F.lit("kind regards|i cannot see"), F.lit(0)))


@query("""select (grouping(model) = 1) is_total, case when grouping(model) = 1 then null else model end model, count(*) n, count(distinct id) n_groups, round(coalesce(avg(latency_ms), 0), 6) latency_mean, round(coalesce(quantile_cont(latency_ms, 0.5), 0), 6) latency_median,
round(avg(coalesce(truncated, false)::int), 6) truncated_rate from raw_answers group by grouping sets ((), (model))""")
def score_summary(spark, d):
    x = profile.score_summary(_ans(spark, d), "model", "id", ["latency_ms"], ["truncated"])
    return x.select("is_total", "model", "n", "n_groups", F.round("latency_ms_mean", 6).alias("latency_mean"), F.round("latency_ms_median", 6).alias("latency_median"), F.round("truncated_rate", 6).alias("truncated_rate"))


@query(_PAIRED + """, s as (select count(*) n, avg(base_pass::int) b, avg(tuned_pass::int) t, count(*) filter (preferred = 'tuned') win, count(*) filter (preferred = 'tie') tie, count(*) filter (preferred = 'base') loss,
count(*) filter (not base_pass and kind = 'hard') base_critical, count(*) filter (not tuned_pass and kind = 'hard') tuned_critical from pairs)
select n, round(b, 6) base_rate, round(t, 6) tuned_rate, round((t - b) * 100, 6) points, win, tie, loss, base_critical, tuned_critical, case when (t - b) * 100 >= 5 and tuned_critical <= base_critical then 'positive' when (t - b) * 100 < 0 or tuned_critical > base_critical then 'negative' else 'inconclusive' end verdict from s""")
def paired_verdict(spark, d):
    p = _pairs(spark, d)
    hard = F.col("kind") == "hard"
    return profile.paired_summary(p, F.lit(0.1), hard & ~F.col("base_pass"), hard & ~F.col("tuned_pass"))


@query("""select coalesce(backend, '') judge, count(*) n, count(*) filter (answer is not null and error is null) passes from raw_answers group by 1""")
def breakdown_by_judge(spark, d):
    a = _ans(spark, d).select((F.col("answer").isNotNull() & F.col("error").isNull()).alias("tuned_pass"), F.lit(False).alias("base_pass"), "backend")
    return profile.paired_breakdown(a, ["backend"]).where("field = 'backend'").select(F.col("value").alias("judge"), "n", F.col("tuned_passes").alias("passes"))


def _close(c):
    return f"list_last(list_filter(list_transform(string_split(regexp_replace(trim({c}, E' \\n\\t\\r'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(p, E' \\n\\t\\r')), lambda p: p <> ''))"


_KIND_SQL = {
    "where_to_look": "you (?:will|can) see|look for|on that page|in that section|under the|labelled|labeled|listed there|shown there|appears there|where to look|the page will",
    "draft_the_message": "draft|you could write|you can write|word it|say something like|here is (?:a|the) (?:message|note|wording)|when you write|in your message|phrase it",
    "have_to_hand": "to hand|on hand|ready before|before you (?:go|start|write|contact)|information you (?:should|will|would) (?:have|need)|what (?:to have|you should have)|gather",
}
_KINDS_OF = "list_filter([" + ", ".join(f"case when regexp_matches(c, '(?i)\\b({p})\\b') then '{k}' end" for k, p in _KIND_SQL.items()) + "], lambda x: x is not null)"


@query(f"""with x as (select coalesce(intent, '?') s, {_close('response')} c from augmentation_context), n as (select count(*) n from x),
f as (select s, c, regexp_extract_all(lower(c), '[a-z][a-z''-]*') w from x where c is not null), g as (select *, array_to_string(w, ' ') f from f where len(w) > 0),
k as (select s, 'sentence' kind, f what from g union all select s, '6-gram', unnest(case when len(w) < 6 then [f] else list_distinct(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' '))) end) from g union all select s, 'kind', unnest({_KINDS_OF}) from g)
select kind, what, count(*) n_rows, count(distinct s) n_strata from k, n group by kind, what having (kind <> 'kind' and (count(*) > 0.1 * max(n.n) or count(distinct s) > 5)) or (kind = 'kind' and count(*) > 0.6 * max(n.n))""")
def closer_breaches(spark, d):
    return profile.closer_audit(_ctx(spark, d), F.col("response"), "intent")


@query(f"with x as (select {_close('answer')} c from raw_answers where answer is not null) select array_to_string({_KINDS_OF}, '|') kinds, count(*) n from (select coalesce(c, '') c from x) group by 1")
def closing_kinds(spark, d):
    a = _ans(spark, d).where("answer is not null").select(rules.closing_kinds(F.col("answer")).alias("kinds"))
    return a.groupBy("kinds").agg(F.count("*").alias("n"))


@query(_PAIRED + """, c as (select id, (tuned_pass::int - base_pass::int)::double s, 1 n, row_number() over (order by id) - 1 i from pairs), k as (select count(*) k from c),
slots as (select b, ('0x' || substr(md5('item:' || b || ':' || c.i), 1, 8))::bigint % k.k i from c, k, range(1, 201) t(b)), m as (select b, sum(s) / sum(n) m from slots join c using (i) group by b)
select (select round(sum(s) / sum(n), 6) from c) estimate, round(quantile_cont(m, 0.025), 6) low, round(quantile_cont(m, 0.975), 6) high from m""")
def bootstrap_items(spark, d):
    p = _pairs(spark, d).withColumn("diff", F.col("tuned_pass").cast("int") - F.col("base_pass").cast("int"))
    return stats.bootstrap_hash(stats.reduce_clusters(p, "id", "diff"), 200, "item")


@query(_PAIRED + """, c as (select intent, avg(tuned_pass::int - base_pass::int)::double s, 1 n, row_number() over (order by intent nulls first) - 1 i from pairs group by intent), k as (select count(*) k from c),
slots as (select b, ('0x' || substr(md5('macro:' || b || ':' || c.i), 1, 8))::bigint % k.k i from c, k, range(1, 501) t(b)), m as (select b, sum(s) / sum(n) m from slots join c using (i) group by b)
select (select round(sum(s) / sum(n), 6) from c) estimate, round(quantile_cont(m, 0.025), 6) low, round(quantile_cont(m, 0.975), 6) high from m""")
def bootstrap_macro(spark, d):
    p = _pairs(spark, d).withColumn("diff", F.col("tuned_pass").cast("int") - F.col("base_pass").cast("int"))
    return stats.bootstrap_hash(stats.reduce_strata(p, "intent", "diff"), 500, "macro")


# --- selection ------------------------------------------------------------------------------------------------------


@query(f"""with g as (select intent, id, group_id, sha256('v3-curation:20260909:' || id) o from augmentation_context where not coalesce(regexp_matches(instruction, '{_ART}'), false)),
f as (select * from (select *, row_number() over (partition by intent, group_id order by o, id) r from g) where r = 1)
select intent, group_id, id, r2::int r from (select *, row_number() over (partition by intent order by o, id) r2 from f) where r2 <= 4""")
def curated_targets(spark, d):
    return selection.curated(_ctx(spark, d), "intent", "group_id", "id", F.col("instruction"), 4, "20260909")[0]


@query("""with n as (select count(*) n from augmentation_context), x as (select id, row_number() over (order by md5('epoch:43:' || id), id) - 1 p from augmentation_context)
select id, (n // 32 + p // 32)::bigint as cursor, 1 epoch, (p // 32)::bigint as batch from x, n where p // 32 < n // 32 and p // 32 >= 2""")
def epoch_from_cursor(spark, d):
    t = _ctx(spark, d)
    per = max(1, t.count() // 32)
    return selection.micro_batches(t, "id", 42, 32, per + 2)


@query(f"""with cells as (select intent, s.style, 40 want from intents, (select unnest(['train', 'val', 'test']) style) s), h as (select {_INTENT_SQL} intent, {_SPLIT_SQL} style, count(*) n from augmentation_context group by 1, 2)
select c.intent, c.style, c.want, coalesce(h.n, 0) have, md5('cells:' || c.intent || ':' || c.style) place from cells c left join h on c.intent = h.intent and c.style = h.style where coalesce(h.n, 0) < c.want""")
def cells_left(spark, d):
    cells = table(spark, d, "intents").select("intent", F.explode(F.array(*map(F.lit, ("train", "val", "test")))).alias("style")).withColumn("want", F.lit(40))
    rows = _ctx(spark, d).select(_intent().alias("intent"), _split().alias("style"))
    return selection.cells_left(cells, rows, ["intent", "style"], "want", "cells")


@query(f"""with cells as (select intent, s.style, 40 want from intents, (select unnest(['train', 'val', 'test']) style) s), h as (select {_INTENT_SQL} intent, {_SPLIT_SQL} style, count(*) n from augmentation_context group by 1, 2)
select c.intent, c.style, c.want, coalesce(h.n, 0) have, md5('cells:' || c.intent || ':' || c.style) place from cells c left join h on c.intent = h.intent and c.style = h.style where coalesce(h.n, 0) < 1 or (c.intent like 'c%' and c.style = 'val')""")
def cells_to_redo(spark, d):
    i = table(spark, d, "intents")
    cells = i.select("intent", F.explode(F.array(*map(F.lit, ("train", "val", "test")))).alias("style")).withColumn("want", F.lit(40))
    rows = _ctx(spark, d).select(_intent().alias("intent"), _split().alias("style"))
    redo = i.where("intent like 'c%'").select("intent", F.lit("val").alias("style"))
    return selection.cells_left(cells, rows, ["intent", "style"], "want", "cells", redo)


@query("""with o as (select group_id, min(intent) intent from augmentation_context where group_id is not null and intent is not null group by group_id), g as (select *, row_number() over (partition by intent order by md5('bf:group:' || group_id), group_id) r, count(*) over (partition by intent) n from o),
b as (select intent, group_id, false backfilled from g where r <= 3), t as (select (select count(*) from b) taken), m as (select intent, group_id, true from (select *, row_number() over (order by r, n desc, intent) k from g where r > 3), t where k <= greatest(0, 50 - taken))
select * from b union all select * from m""")
def quota_backfilled(spark, d):
    t = _ctx(spark, d).where("intent is not null")
    return selection.quota_backfilled(t, "intent", "group_id", "id", 3, 50, "bf").select("intent", "group_id", "backfilled")


# --- audits ---------------------------------------------------------------------------------------------------------


@query("""with x as (select id, intent, kind, regexp_extract(id, '^([a-z0-9]+)-(\\d{3})$', 1) p, nullif(regexp_extract(id, '^([a-z0-9]+)-(\\d{3})$', 2), '')::int i, lower(trim(query)) q from scenarios),
t as (select count(*) n, count(distinct p) prefixes, max(i) - min(i) + 1 span, count(distinct i) numbers from x)
select 'row_count' rule_id, 'all' row_key, n::varchar detail from t, (select count(*) * 30 want from intents) where n <> want union all
select 'repeated_id', id, count(*)::varchar from x group by id having count(*) > 1 union all select 'prefixes', 'all', prefixes::varchar from t where prefixes <> 1 union all
select 'numbers_with_gaps', 'all', (span - numbers)::varchar from t where span <> numbers union all select 'cell_size', intent || '/' || kind, count(*)::varchar from x group by intent, kind having count(*) * 2 <> 30 union all
select 'intent_without_items', intent, '' from intents where intent not in (select intent from x where intent is not null) union all select 'same_query', min(id), count(*)::varchar from x where q <> '' group by q having count(*) > 1""")
def layout_violations(spark, d):
    return audits.layout_violations(_items(spark, d), table(spark, d, "intents"), 30)


_HITS = f"""select s.id, count(c.gram) n from scenarios s left join (select distinct h.id, h.gram from (select id, unnest({_GRAMS}) gram from (select id, {_tokens('query')} w from scenarios)) h
where h.gram in (select unnest({_GRAMS}) from (select {_tokens('instruction')} w from augmentation_context))) c on c.id = s.id group by s.id"""


@query(f"""with m as (select s.id, s.max_bitext_cosine v, round(s.max_bitext_cosine, 3) bitext, s.max_bitext_cosine - 0.01 against, h.n hits from scenarios s join ({_HITS}) h on s.id = h.id)
select unnest(list_filter([case when bitext >= 0.85 then 'bitext_cap' end, case when against >= 0.80 then 'against_cap' end, case when abs(v - round(bitext, 4)) > 0.0001 + 1e-12 then 'stored_differs' end, case when hits > 0 then 'shared_grams' end], lambda x: x is not null)) rule_id, id row_key, '' detail from m""")
def metric_violations(spark, d):
    items = _items(spark, d)
    hits = joins.screen_by_grams(items, "id", F.col("query"), _ctx(spark, d), F.col("instruction")).select("id", F.col("n_shared").alias("six_gram_hits"))
    m = items.select("id", F.round("max_bitext_cosine", 3).alias("bitext"), (F.col("max_bitext_cosine") - 0.01).alias("against")).join(hits, "id")
    return audits.metric_violations(items, m)


@query(f"""with s as ({SQL['leak_sixgram_screen']}), n as (select id, md5(id) < '2' far from augmentation_context)
select s.id, case when far then 0.9 else 0.4 end max_cosine, pass and not far pass, array_to_string(list_filter([case when exact then 'exact' end, case when n_shared > 0 then 'shared_grams' end, case when far then 'cosine' end], lambda x: x is not null), '|') reasons from s join n on s.id = n.id""")
def leak_verdicts(spark, d):
    near = _ctx(spark, d).select("id", F.when(F.md5("id") < "2", 0.9).otherwise(0.4).alias("similarity"))
    return audits.leak_verdict(leak_sixgram_screen(spark, d), near, "id")


@query("""with k as (select id item_id, sha256(query) immutable from scenarios where id <> 'ch2-005'), s as (select id item_id, row_number() over (order by id)::int question_number, case when id = 'ch2-007' then sha256(query || 'x') else sha256(query) end immutable, kind from scenarios where id <> 'ch2-009'),
x as (select s.*, case when question_number % 50 = 0 then 'missing' else 'human' end judge_source, case when question_number % 50 = 0 and question_number <> 100 then '' else 'true' end verdict, case when question_number % 50 = 0 then '' when kind = 'hard' then 'A' else 'C' end preferred from s),
j as (select x.*, k.immutable sealed, question_number in (50, 100, 5000) skip from x left join k using (item_id))
select unnest(list_filter([case when sealed is null then 'unknown_item' end, case when immutable <> sealed then 'immutable_changed' end, case when skip and not (trim(verdict) = '' and trim(preferred) = '' and judge_source = 'missing') then 'skip_not_blank' end,
case when not skip and preferred not in ('A', 'B', 'tie') then 'preference' end, case when not skip and verdict not in ('true', 'false') then 'verdict' end], lambda x: x is not null)) rule_id, item_id row_key, '' detail from j
union all select 'missing_item', item_id, '' from k where item_id not in (select item_id from x) union all select 'skip_without_row', '5000', ''""")
def partial_sheet_violations(spark, d):
    items = _items(spark, d).select("id", "query", "kind")
    key = items.where("id <> 'ch2-005'").select(F.col("id").alias("item_id"), F.sha2("query", 256).alias("immutable"))
    s = sources.with_row_ids(items.where("id <> 'ch2-009'").withColumnRenamed("id", "item_id"), "", ["item_id"]).withColumn("question_number", F.col("id").cast("int") + 1)
    skip, n = F.col("question_number") % 50 == 0, F.col("question_number")
    changed = F.when(F.col("item_id") == "ch2-007", F.sha2(F.concat("query", F.lit("x")), 256)).otherwise(F.sha2("query", 256))
    sheet = s.select("item_id", "question_number", changed.alias("immutable"), F.when(skip, "missing").otherwise("human").alias("judge_source"), F.when(skip & (n != 100), "").otherwise("true").alias("verdict"), F.when(skip, "").when(F.col("kind") == "hard", "A").otherwise("C").alias("preferred"))
    return audits.sheet_violations(sheet, key, [50, 100, 5000])


@query(f"""with r as (select id, group_id from augmentation_context where {_SPLIT_SQL} = 'val'), t as (select id, pass, n_shared from ({SQL['leak_sixgram_screen']}) where md5(id) < 'f')
select 'not_screened' rule_id, id row_key, '' detail from r where id not in (select id from t) union all select 'unknown_result', id, '' from t where id not in (select id from r) union all
select 'repeated_id', id, count(*)::varchar from r group by id having count(*) > 1 union all select 'repeated_group', group_id, count(*)::varchar from r where group_id is not null group by group_id having count(*) > 1 union all
select unnest(list_filter([case when not pass then 'failed' end, case when n_shared > 0 then 'shared_grams' end], lambda x: x is not null)), id, '' from t""")
def screening_violations(spark, d):
    results = leak_sixgram_screen(spark, d).where(F.md5("id") < "f").select("id", "pass", F.lit(0.4).alias("max_cosine"), "n_shared")
    return audits.screening_violations(_ctx(spark, d).where(_split() == "val"), results)


@query("select rule_id, row_key, detail from (select 'value' rule_id, intent row_key, category detail from intents where intent in ('cancel_order', 'track_order', 'get_refund') and not regexp_matches(category, '^ORDER$') union all select 'missing_key', 'linkage', '')")
def setting_violations(spark, d):
    s = table(spark, d, "intents").select(F.col("intent").alias("key"), F.col("category").alias("value"))
    return audits.setting_violations(s, {"cancel_order": "^ORDER$", "track_order": "^ORDER$", "get_refund": "^ORDER$", "linkage": "^(single|average)$"})


@query(f"""with a as (select intent, sha256(category) a from intents where category <> 'FEEDBACK'), b as (select intent, sha256(max(category)) b from (select {_INTENT_SQL} intent, category from augmentation_context) where intent is not null group by intent),
x as (select coalesce(a.intent, b.intent) intent, a, b, a.intent is not null l, b.intent is not null r from a full outer join b on a.intent = b.intent)
select unnest(list_filter([case when not r then 'missing' end, case when not l then 'added' end, case when l and r and a is distinct from b then 'changed' end], lambda x: x is not null)) rule_id, intent row_key, '' detail from x""")
def seal_violations(spark, d):
    sealed = table(spark, d, "intents").where("category <> 'FEEDBACK'").select("intent", F.sha2("category", 256).alias("sha"))
    found = _ctx(spark, d).select(_intent().alias("intent"), "category").where("intent is not null").groupBy("intent").agg(F.sha2(F.max("category"), 256).alias("sha"))
    return audits.seal_violations(sealed, found, "intent")


@query("""select rule_id, count(*) n from (select unnest(list_filter([case when coalesce(trim(answer) = '', true) then 'answer' end, case when not coalesce(prompt_tokens >= 1, false) then 'prompt_tokens' end, case when not coalesce(gen_tokens >= 1, false) then 'gen_tokens' end,
case when not coalesce(latency_ms > 0 and not isnan(latency_ms) and not isinf(latency_ms), false) then 'latency_ms' end, case when not coalesce(tokens_per_s > 0 and not isnan(tokens_per_s) and not isinf(tokens_per_s), false) then 'tokens_per_s' end, case when truncated is null then 'truncated' end], lambda x: x is not null)) rule_id from raw_answers) group by rule_id""")
def response_violations(spark, d):
    return validate.row_violations(_ans(spark, d), "answer_id", audits.response_rules()).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("""with g as (select tag, count(*) n, count(*) filter (error is not null) bad from raw_answers where tag is not null group by tag)
select 'request_count' rule_id, tag row_key, n::varchar detail from g where n <> 100 union all select 'failures', tag, bad::varchar from g where bad > 0""")
def block_violations(spark, d):
    return audits.block_violations(_ans(spark, d).where("tag is not null"), "tag", 100, F.col("error").isNotNull())


@query(f"""with p as (select field, value, n::double n, points from ({SQL['paired_breakdown']}) where not (field = 'kind' and value = 'ordinary')), c as (select field, value, n, case when field = 'all' then points + 1 else points end points from ({SQL['paired_breakdown']}) where field <> 'intent' or value <> 'get_refund')
select 'not_recomputed' rule_id, 'intent/get_refund' row_key, unnest(['n', 'points']) detail union all select 'not_published', 'kind/ordinary', unnest(['n', 'points']) union all select 'differs', 'all/all', 'points' from p where field = 'all'""")
def replay_violations(spark, d):
    b = paired_breakdown(spark, d).select("field", "value", "n", "points")
    computed = b.where("field <> 'intent' or value <> 'get_refund'").withColumn("points", F.when(F.col("field") == "all", F.col("points") + 1).otherwise(F.col("points")))
    return audits.replay_violations(b.where("not (field = 'kind' and value = 'ordinary')"), computed, ["field", "value"], ["n", "points"], 1e-9)


@query(f"""with s as (select id, model, arg_max(answer, answer_id) a from raw_answers where id is not null and answer is not null group by 1, 2)
select x.id, len({_tokens('x.a')}) n_tokens, {_tokens('x.a')} = {_tokens('y.a')} tokens_match, x.a = y.a text_match from s x join s y on x.id = y.id and x.model = 'base' and y.model = 'tuned'""")
def generation_parity(spark, d):
    a = _ans(spark, d).where("id is not null and answer is not null")
    side = lambda m: a.where(F.col("model") == m).groupBy("id").agg(F.max_by("answer", "answer_id").alias("a")).select("id", "a", X.tokens(F.col("a")).alias("t"))
    return audits.parity(side("base"), side("tuned"), "id", "t", "a")


@query("""select rule_id, count(*) n from (select unnest(list_filter([case when value is null then 'missing' end, case when value >= 30000 then 'over_limit' end], lambda x: x is not null)) rule_id from (select latency_ms as value from raw_answers)) group by rule_id""")
def series_violations(spark, d):
    x = _ans(spark, d).select("answer_id", F.col("latency_ms").alias("value"))
    return validate.row_violations(x, "answer_id", validate.series_rules(30_000)).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("""with x as (select answer_id, coalesce(truncated, false) critical, gen_tokens >= 100 passed, latency_ms > 5000 credential from raw_answers)
select rule_id, count(*) n from (select unnest(list_filter([case when passed and critical then 'pass_with_critical' end, case when passed and credential then 'pass_with_credential' end, case when credential and not critical then 'credential_not_critical' end], lambda x: x is not null)) rule_id from x) group by rule_id""")
def judgment_violations(spark, d):
    x = _ans(spark, d).select("answer_id", F.coalesce("truncated", F.lit(False)).alias("critical"), (F.col("gen_tokens") >= 100).alias("passed"), (F.col("latency_ms") > 5000).alias("credential"))
    return validate.row_violations(x, "answer_id", validate.judgment_rules("passed", "critical", "credential")).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("""select rule_id, count(*) n from (select unnest(list_filter([case when source is null or source like '/%' then 'path' end, case when n_chars is null or n_chars < 1 then 'bytes' end, case when lang is null then 'base_revision' end], lambda x: x is not null)) rule_id from documents) group by rule_id""")
def manifest_violations(spark, d):
    t = table(spark, d, "documents")
    x = t.select("doc_id", F.col("source").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.col("n_chars").alias("bytes"), F.lit(None).cast("string").alias("hub_url"), F.substring(F.sha2("lang", 256), 1, 40).alias("base_revision"))
    picked = {k: v for k, v in rules.artifact_rules().items() if k in ("path", "sha256", "bytes", "hub_url", "base_revision")}
    return validate.row_violations(x, "doc_id", picked).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(f"""select {_SPLIT_SQL} split, count(*) n_rows, count(distinct group_id) n_groups, sum(('0x' || substr(sha256(concat_ws(':', id, coalesce(group_id, ''))), 1, 12))::bigint % 1000000007)::bigint digest from augmentation_context where split is not null group by 1""")
def split_manifest(spark, d):
    x = _ctx(spark, d).where("split is not null").withColumn("split", _split())
    return validate.split_manifest(x, "split", "group_id", "id")


@query("""select strftime(time_bucket(interval '6 hours', ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) n, round(sum(value), 4) total from events where ts is not null group by 1, 2""")
def event_windows(spark, d):
    x = streaming.windowed_counts(table(spark, d, "events").where("ts is not null"), "ts", window="6 hours")
    return x.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


# --- grouping -------------------------------------------------------------------------------------------------------


@query()
def complete_link_groups(spark, d):
    """Clusters of complete linkage inside a label, then joined where rows share a value (here the id modulo 97)."""
    v = _vec(spark, d)
    return grouping.linkage_groups(v, "vec_id", "embedding", "label", [F.when(F.col("vec_id") % 97 < 3, (F.col("vec_id") % 97).cast("string"))], 0.35, complete=True)


