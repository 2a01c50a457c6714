"""Registered queries of the general operators and their SQL. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import plans, sources, streaming
from corpusloom.functions import text as X
from corpusloom.operators import grouping, joins, profile, rules, selection, sheets, stats, validate
from corpusloom.session import table
from corpusloom.sources import sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ctx(spark, d):
    return table(spark, d, "augmentation_context")


def _ans(spark, d):
    return table(spark, d, "raw_answers")


def _items(spark, d):
    return table(spark, d, "scenarios")


def _vec(spark, d):
    return table(spark, d, "embeddings")


def _split():
    return F.when(F.lower("split") == "validation", "val").otherwise(F.lower("split"))


def _intent():
    return F.lower(F.replace(F.trim("intent"), F.lit(" "), F.lit("_")))


_SPLIT_SQL = "case when lower(split) = 'validation' then 'val' else lower(split) end"
_INTENT_SQL = "lower(replace(trim(intent), ' ', '_'))"


def _fold(c):
    return f"replace(lower({c}), 'ß', 'ss')"


def _tokens(c):
    return f"regexp_extract_all({_fold(c)}, '[a-z0-9]+(?:''[a-z0-9]+)?')"


def _grams(w, n=6):
    return f"list_distinct(list_transform(range(1, greatest(len({w}) - {n - 1}, 0) + 1), lambda i: array_to_string({w}[i:i + {n - 1}], ' ')))"


def _norm(c):
    x = f"regexp_replace({_fold(c)}, '\\{{\\{{([^{{}}]+)\\}}\\}}', ' ph ', 'g')"
    x = f"replace({x}, 'n''t', ' not ')"
    return f"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


# --- leakage screen (the flagship) ----------------------------------------------------------------------------------


@query(f"""
with g as (select distinct unnest({_grams('w')}) gram from (select {_tokens('query')} w from scenarios)),
c as (select id, {_tokens('instruction')} w from augmentation_context),
e as (select id, unnest({_grams('w')}) gram from c),
s as (select id, count(*) n from e join g using (gram) group by id),
h as (select distinct array_to_string({_tokens('query')}, ' ') norm from scenarios)
select c.id, coalesce(s.n, 0) n_shared, h.norm is not null exact, coalesce(s.n, 0) = 0 and h.norm is null pass
from c left join s on c.id = s.id left join h on array_to_string(c.w, ' ') = h.norm and h.norm <> ''""")
def leak_sixgram_screen(spark, d):
    return joins.screen_by_grams(_ctx(spark, d), "id", F.col("instruction"), _items(spark, d), F.col("query"))


@query("""
select pass, count(*) n, sum(n_shared)::bigint n_shared from (""" + SQL["leak_sixgram_screen"] + """) group by pass""")
def leak_screen_summary(spark, d):
    return leak_sixgram_screen(spark, d).groupBy("pass").agg(F.count("*").alias("n"), F.sum("n_shared").alias("n_shared"))


# --- text functions -------------------------------------------------------------------------------------------------


@query(f"select id, {_norm('instruction')} norm, {_norm('response')} template_like, len({_tokens('instruction')}) n_tokens_ascii, len(regexp_extract_all(response, '[A-Za-z][A-Za-z''’-]*')) n_words, array_to_string(string_split(trim(regexp_replace(instruction, '\\s+', ' ', 'g')), ' ')[1:8], ' ') head from augmentation_context")
def text_normal_forms(spark, d):
    return _ctx(spark, d).select("id", X.normalize_ascii(F.col("instruction")).alias("norm"), X.response_template(F.col("response")).alias("template_like"), F.size(X.tokens(F.col("instruction"))).alias("n_tokens_ascii"), X.word_count(F.col("response")).alias("n_words"), X.first_words(F.col("instruction")).alias("head")).withColumn("n_tokens_ascii", F.when(F.col("n_tokens_ascii") >= 0, F.col("n_tokens_ascii").cast("long"))).withColumn("n_words", F.when(F.col("n_words") >= 0, F.col("n_words").cast("long")))


@query()
def text_unicode_form(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_unicode(F.col("text")).alias("norm"))


@query("select id, array_to_string(regexp_extract_all(lower(query), '[a-z][a-z''-]*'), ' ') closing_form, trim(regexp_replace(regexp_replace(lower(intent), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) as slugged from scenarios")
def text_closing_form_slug(spark, d):
    return _items(spark, d).select("id", X.closing_form(F.col("query")).alias("closing_form"), F.substring(X.slug("p", F.col("intent")), 3, 1000).alias("slugged"))


@query("select answer_id, case when regexp_matches(regexp_replace(answer, '^\\s+', ''), '^[=+\\-@]') or regexp_matches(answer, '^[\\t\\r\\n]') then '''' || answer else answer end cell from raw_answers")
def safe_sheet_cells(spark, d):
    return _ans(spark, d).select("answer_id", X.safe_cell(F.col("answer")).alias("cell"))


# --- profiles -------------------------------------------------------------------------------------------------------


@query(f"select {_INTENT_SQL} as value, count(*) n, round(count(*) * 100.0 / sum(count(*)) over (), 4) share from augmentation_context group by 1")
def profile_value_counts(spark, d):
    return profile.value_counts(_ctx(spark, d), _intent())


@query("""select count(*) unique_values, count(*) filter (n > 1) values_with_dup, coalesce(sum(n) filter (n > 1), 0)::bigint rows_in_dup,
coalesce(sum(n - 1) filter (n > 1), 0)::bigint extra_rows from (select text, count(*) n from documents group by text)""")
def profile_duplicates(spark, d):
    return profile.duplicate_report(table(spark, d, "documents"), F.col("text"))


@query("""select lang, count(n_chars) n, min(n_chars)::double least, max(n_chars)::double most, round(avg(n_chars), 6) mean,
quantile_cont(n_chars::double, 0.5) p50, quantile_cont(n_chars::double, 0.9) p90, quantile_cont(n_chars::double, 0.99) p99 from documents group by lang""")
def profile_length_percentiles(spark, d):
    return profile.percentiles(table(spark, d, "documents"), ["lang"], F.col("n_chars"))


@query("select item, count(*) n from (select unnest(string_split(flags, '')) item from augmentation_context where flags is not null and flags <> '') group by item")
def profile_flag_letters(spark, d):
    return profile.item_counts(_ctx(spark, d).where("flags <> ''"), F.split("flags", ""))


@query("select item, count(*) n from (select unnest(cleaning) item from augmentation_context) group by item")
def cleaning_rule_counts(spark, d):
    return profile.item_counts(_ctx(spark, d), F.col("cleaning"))


@query("""select * from (select array_to_string(string_split(trim(regexp_replace(instruction, '\\s+', ' ', 'g')), ' ')[1:8], ' ') as value, count(*) n
from augmentation_context where instruction is not null group by 1) order by n desc, value limit 20""")
def profile_top_templates(spark, d):
    x = _ctx(spark, d).where("instruction is not null").groupBy(X.first_words(F.col("instruction")).alias("value")).agg(F.count("*").alias("n"))
    return profile.top_k(x, 20)


@query(f"""with g as (select {_INTENT_SQL} stratum, group_id, count(*) n from augmentation_context group by 1, 2)
select stratum, sum(n)::bigint n_rows, count(*) n_groups, max(n) largest, count(*) filter (n = 1) singletons,
round(max(n) / sum(n), 4) share, max(n) / sum(n) >= 0.5 near_collapse from g group by stratum""")
def group_stats(spark, d):
    return profile.group_stats(_ctx(spark, d).withColumn("stratum", _intent()), "stratum", "group_id")


@query("select sum(n_rows)::bigint n_rows, sum(n_groups)::bigint n_groups, max(largest) largest, count(*) filter (near_collapse) near_strata from (" + SQL["group_stats"] + ")")
def group_stats_summary(spark, d):
    return profile.linkage_summary(group_stats(spark, d))


@query(f"select {_INTENT_SQL} stratum, count(*) filter ({_SPLIT_SQL} = 'train') train, count(*) filter ({_SPLIT_SQL} = 'val') val, count(*) filter ({_SPLIT_SQL} = 'test') test from augmentation_context group by 1")
def split_crosstab(spark, d):
    return profile.crosstab(_ctx(spark, d).select(_intent().alias("stratum"), _split().alias("s")), "stratum", "s", ["train", "val", "test"])


@query("""select id, intent, flags from (select id, intent, flags, row_number() over (partition by intent order by (coalesce(flags, '') = 'B') desc, id) r from augmentation_context) where r = 1""")
def intent_examples(spark, d):
    return profile.first_per_key(_ctx(spark, d).select("id", "intent", "flags"), "intent", F.coalesce("flags", F.lit("")) == "B", "id").select("id", "intent", "flags")


@query("""select model, backend, count(*) attempts, count(*) filter (error is not null) failures,
round(quantile_cont(case when error is null then latency_ms end, 0.5), 4) p50, round(quantile_cont(case when error is null then latency_ms end, 0.95), 4) p95,
round(count(*) / (sum(latency_ms) / 1000), 6) per_second, round(sum(gen_tokens) / (sum(latency_ms) / 1000), 4) tokens_per_second from raw_answers group by 1, 2""")
def latency_summary(spark, d):
    return profile.latency_summary(_ans(spark, d), ["model", "backend"], "latency_ms", "gen_tokens", F.col("error").isNotNull())


@query("select tag, round(sum(tokens_per_s * gen_tokens) / sum(gen_tokens) filter (tokens_per_s is not null), 6) mean from raw_answers group by tag")
def token_weighted_rate(spark, d):
    return profile.weighted_mean(_ans(spark, d), ["tag"], "tokens_per_s", "gen_tokens")


@query("select tag, round(sum(coalesce(gen_tokens, prompt_tokens))::double, 4) total from raw_answers group by tag")
def usage_or_reserve(spark, d):
    return profile.reserve_or_usage(_ans(spark, d), ["tag"], "gen_tokens", "prompt_tokens").withColumn("total", F.col("total").cast("double"))


@query("""select coalesce(tag, '') tag, count(*) n, count(*) filter (trim(coalesce(answer, '')) = '') empty, count(*) filter (truncated is true or gen_tokens >= 256) truncated,
count(*) filter (contains(answer, '{{')) slot, sum(coalesce(gen_tokens, len(regexp_extract_all(coalesce(answer, ''), '\\S+'))))::bigint tokens from raw_answers group by grouping sets ((), (tag))""")
def answer_status(spark, d):
    a = _ans(spark, d).select("tag", F.coalesce("answer", F.lit("")).alias("a"), "truncated", "gen_tokens")
    n = F.coalesce(F.col("gen_tokens").cast("long"), F.size(F.regexp_extract_all("a", F.lit(r"\S+"), F.lit(0))).cast("long"))
    k = a.withColumn("k", F.explode(F.array(F.coalesce("tag", F.lit("")), F.lit("<all>")))).withColumn("tokens", n)
    g = k.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.trim("a") == "").alias("empty"), F.count_if(F.col("truncated").eqNullSafe(F.lit(True)) | (F.col("gen_tokens") >= 256)).alias("truncated"), F.count_if(F.col("a").contains("{{")).alias("slot"), F.sum("tokens").alias("tokens"))
    return g.select(F.when(F.col("k") == "<all>", "").otherwise(F.col("k")).alias("tag"), "n", "empty", "truncated", "slot", "tokens")


# --- rules ----------------------------------------------------------------------------------------------------------


@query()
def clean_rows(spark, d):
    return rules.clean(_ctx(spark, d)).select("id", "clean_instruction", "clean_response", "reject_id", "over_length")


@query("""with x as (select id, coalesce(instruction, '') i, coalesce(response, '') r from augmentation_context),
y as (select *, regexp_extract_all(i, '\\d+') ni, regexp_extract_all(regexp_extract(r, '(?i)\\b(?:within|in) \\d+ (?:hours?|days?|weeks?)\\b|\\b\\d+ days most likely\\b'), '\\d+') nr from x)
select reject_id, count(*) n from (select case
when regexp_matches(r, '(?i)\\b(?:i have|i''ve|we have|we''ve) (?:already )?(?:cancelled|canceled|processed|refunded|updated)\\b') then 'reject_completed_action'
when regexp_matches(r, '(?i)\\b(?:within|in) \\d+ (?:hours?|days?|weeks?)\\b|\\b\\d+ days most likely\\b') and not (len(nr) > 0 and list_has_all(ni, nr)) then 'reject_invented_timeline'
when regexp_matches(r, '(?i)\\b(?:send|share|provide|give)\\b.{0,30}\\b(?:password|pin|card number)\\b') then 'reject_request_credentials'
when trim(i, E' \\n\\t\\r') = '' or trim(r, E' \\n\\t\\r') = '' then 'reject_empty_after_clean' end reject_id from y) group by reject_id""")
def clean_reject_reasons(spark, d):
    return clean_rows(spark, d).groupBy("reject_id").agg(F.count("*").alias("n"))


@query()
def placeholder_rewrite(spark, d):
    """The fold over placeholders in both fields, with the substitutions; its golden pairs are in the tests."""
    slots = rules.Slots(substitute=rules.SUBSTITUTIONS)
    i, r = F.coalesce("instruction", F.lit("")), F.coalesce("response", F.lit(""))
    made = {"rewritten_instruction": rules.rewrite_slots(i, "instruction", slots), "rewritten": rules.rewrite_slots(r, "response", slots), "reject_id": F.coalesce(rules.slot_reject(i, slots), rules.slot_reject(r, slots))}
    return _ctx(spark, d).select("id", *[c.alias(k) for k, c in made.items()])


def _words_sql(c):
    return f"list_distinct(list_transform(regexp_extract_all({_fold(c)}, '[a-z][a-z''’-]*'), lambda w: regexp_replace(w, '^[''’-]+|[''’-]+$', '', 'g')))"


def _lint_sql(c, field):
    free = "case i when 'check_cancellation_fee' then ['fee', 'fees', 'charge', 'charges'] when 'recover_password' then ['password', 'passwords'] else []::varchar[] end"
    words = f"list_filter({_words_sql(c)}, lambda w: not list_contains({free}, w))"
    said = f"case i when 'check_cancellation_fee' then regexp_replace({c}, '(?i)\\b(?:fee|fees|charge|charges)\\b', ' ', 'g') when 'recover_password' then regexp_replace({c}, '(?i)\\b(?:password|passwords)\\b', ' ', 'g') else {c} end"
    hits = [f"case when regexp_matches({c}, '[0-9]') then '{field}:digit' end", f"case when regexp_matches({c}, '[$€£¥₹¢%]') then '{field}:currency_symbol' end"]
    hits += [f"case when regexp_matches({c}, '(?i)(https?://|www\\.|\\b[a-z0-9-]+\\.(?:com|net|org|io|co|in)\\b|@[a-z0-9-]+\\.)') then '{field}:url_or_address' end"]
    hits += [f"case when contains({c}, '24/7') or contains(lower({c}), 'twenty-four seven') or contains(lower({c}), '24x7') then '{field}:always_open' end"]
    hits += [f"case when list_has_any({words}, {w!r}) then '{field}:{k}' end" for k, w in rules.LINT_WORDS.items()]
    hits += [f"case when regexp_matches({said}, '(?i)\\b(password|passwords|pin|otp|cvv|cvc|passcode|credential|credentials|one-time code|security code|verification code|card number|login details)\\b') then '{field}:credential_request' end"]
    return f"list_filter([{', '.join(hits)}], lambda x: x is not null)"


_DONE_SQL = "(?i)\\b(i(?:''ve| have)\\s+(?:already\\s+)?(?:processed|cancelled|canceled|updated|refunded|escalated|checked|located|found|submitted|changed|removed|sent|raised|gone ahead|arranged|reset|opened)|(?:has|have) been (?:processed|cancelled|canceled|updated|refunded|escalated|raised|reset))"
_OFFER_SQL = (
    "(?i)(\\b(?:i(?:''ll| will| can)|let me|allow me to|happy to)\\s+(?:just\\s+|quickly\\s+|go ahead and\\s+)?(?:look(?:ing)? up|look into|pull up|check|verify|confirm|track|locate|find|retrieve|process|issue|cancel|refund|update|escalate|raise|forward|transfer|connect|put you through|reset|open|arrange|submit)"
    "|\\b(?:connect(?:ing)?|transfer(?:ring)?) you\\b|\\bput you through\\b|\\bour (?:team|agents?|department|specialists?)\\s+(?:will|can)\\b|\\ba (?:representative|specialist|agent|colleague)\\s+(?:will|can)\\b)"
)


@query(f"""with x as (select id, {_INTENT_SQL} i, coalesce(instruction, '') q, coalesce(response, '') a from augmentation_context),
y as (select *, len(regexp_extract_all(a, '[A-Za-z][A-Za-z''’-]*')) n, len(regexp_extract_all(q, '[A-Za-z][A-Za-z''’-]*')) m, {_fold('a')} f from x)
select id, array_to_string(list_sort(list_concat(list_concat({_lint_sql('q', 'query')}, {_lint_sql('a', 'answer')}),
list_filter([case when n < 35 or n > 75 then 'answer:word_band(' || n || ')' end, case when m < 4 then 'query:too_short' end, case when contains(f, 'i''m on it') or contains(f, 'i am on it') or contains(f, 'i''m on the same wavelength') or contains(f, 'rest assured') then 'answer:bitext_opener' end,
case when regexp_matches(a, '{_DONE_SQL}') then 'answer:completed_action' end, case when regexp_matches(a, '{_OFFER_SQL}') then 'answer:offers_lookup_or_transfer' end], lambda x: x is not null))), '|') lint from y""")
def lint_rows(spark, d):
    x = rules.lint(_ctx(spark, d), F.coalesce("instruction", F.lit("")), F.coalesce("response", F.lit("")), _intent())
    return x.select("id", F.array_join("lint", "|").alias("lint"))


@query("""with t as (select answer_id, replace(lower(translate(answer, '‘’‛′', '''''''''')), 'ß', 'ss') x from raw_answers where answer is not null)
select answer_id, """ + " or ".join(f"contains(x, '{p.replace(chr(39), chr(39) * 2)}')" for p in rules.ADMIT) + """ admit, array_to_string(list_filter([""" + ", ".join(f"case when contains(x, '{p.replace(chr(39), chr(39) * 2)}') then '{p.replace(chr(39), chr(39) * 2)}' end" for p in rules.ADMIT) + """], lambda p: p is not null), '|') admit_phrases,
starts_with(ltrim(x), 'i''m on it') or starts_with(ltrim(x), 'i''m on the same wavelength') opener, contains(x, 'rest assured') rest_assured, contains(x, 'i can''t assist with that') declines from t""")
def phrase_scan(spark, d):
    a = _ans(spark, d).where("answer is not null").select("answer_id", "answer")
    return rules.phrase_scan(a, F.col("answer")).drop("answer")


def _asked_sql(p):
    warned = "(?i)(?:\\b(?:never|do\\s+not|don''t|should\\s+not|shouldn''t|must\\s+not|avoid)\\s+|\\b(?:never|will\\s+not|won''t)\\s+ask(?:\\s+\\w+){0,3}\\s+to\\s+)$"
    hit = f"regexp_extract(x, '{p}')"
    before = f"left(x, strpos(x, {hit}) - 1)"
    return f"case when {hit} <> '' and not regexp_matches(right({before}, 60), '{warned}') then {hit} end"


_ASK_SQL = "(?i)\\b(?:provide|send|share|tell\\s+me|give\\s+me)\\b.{0,40}"


@query("select answer_id, found from (select answer_id, coalesce(" + ", ".join(_asked_sql(p) for p in (
    _ASK_SQL + "\\b(?:current\\s+)?password\\b", _ASK_SQL + "\\b(?:full\\s+)?(?:credit\\s+|debit\\s+|payment\\s+)?card\\b", _ASK_SQL + "\\b(?:cvv|cvc|pin|security\\s+code)\\b",
    "(?i)\\benter\\b.{0,40}\\b(?:password|card|cvv|cvc|pin|security\\s+code)\\b.{0,20}\\b(?:here|below|in\\s+(?:this\\s+)?chat)\\b")) + ") found from (select answer_id, coalesce(answer, '') x from raw_answers)) where found is not null")
def credential_requests(spark, d):
    a = _ans(spark, d).select("answer_id", rules.credential_request(F.coalesce("answer", F.lit(""))).alias("found"))
    return a.where("found is not null")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) s, generate_subscripts(string_split(text, chr(10)), 1) line from documents where text is not null),
f as (select doc_id, line, 'secret' kind, unnest(regexp_extract_all(s, 'hf_[A-Za-z0-9]{20,}|gh[po]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----')) found from l
union all select doc_id, line, 'phone', unnest(regexp_extract_all(s, '(?:^|[^A-Za-z0-9_/#-])(\\+\\d{1,2}[\\s-]?\\d{3,5}[\\s-]?\\d{3,5}(?:[\\s-]?\\d{4})?)', 1)) from l
union all select doc_id, line, 'email', unnest(list_filter(regexp_extract_all(s, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\\.[A-Za-z0-9_-]+)*\\.[A-Za-z]{2,}'), lambda m: not regexp_matches(lower(m), '(?:example\\.com|example\\.org)$'))) from l)
select doc_id, line::int line, kind, found from f""")
def pii_secret_scan(spark, d):
    return rules.secret_scan(table(spark, d, "documents"), "doc_id", "text")


_FAMILY_SQL = (
    ("Asks for a secret", "asks for .*(password|card number)"), ("Pretends to be a human, or answers outside support", "speaking to a human|on the line with an agent|warehouse job|ceo salary|named gym|cash to the sister|packing is garbage"),
    ("States policy, a fee, or a window as fact", "policy|fee|window as fact|refundable|no-questions|cutoff as fact|discounts will stack|automatically zeroes"),
    ("Promises a date, a timeline, or an amount", "timeline|ship date|arrival date|arrive|day count|completion date|callback|call today|deadline|on the way|will work today|when the money|shipped today|in the bank|money has arrived|pickup point|same-day|tomorrow"),
    ("Invents a fact it was never given", "invents|in stock|stock of|is unused|globally down|widget is working|as fact$|quotes a phone number|support hours|specific couriers|star rating|courier scan|current location"),
)


@query("select family, count(*) n from (select case " + " ".join(f"when regexp_matches(lower(l), '{p}') then '{n}'" for n, p in _FAMILY_SQL) + " else 'Claims an action it cannot take' end family from (select unnest(critical_fail_if) l from scenarios) where l is not null) group by family")
def critical_families(spark, d):
    x = _items(spark, d).select(F.explode("critical_fail_if").alias("l")).where("l is not null")
    return x.groupBy(rules.first_family(F.col("l"), rules.FAMILIES, rules.LAST_FAMILY).alias("family")).agg(F.count("*").alias("n"))


@query(f"""with x as (select intent, {_grams("regexp_extract_all(lower(response), '[a-z][a-z''-]*')")} g from augmentation_context where response is not null), n as (select count(*) n from x)
select gram, count(*) n_rows, count(distinct intent) n_strata, round(count(*) / max(n.n), 6) row_share from (select intent, unnest(g) gram from x), n group by gram having count(*) > 0.1 * max(n.n) or count(distinct intent) > 5""")
def closer_concentration(spark, d):
    x = _ctx(spark, d).where("response is not null").withColumn("w", F.split(X.closing_form(F.col("response")), " "))
    return profile.concentration(x, X.ngrams(F.col("w")), "intent")


@query("""select id, coalesce(list_bool_and(list_transform(regexp_extract_all(instruction, '\\d{3,}'), lambda n: contains(response, n))), true) kept, contains(response, '<|im_start|>') or contains(response, '<|im_end|>') or contains(response, '<|endoftext|>') control
from augmentation_context where instruction is not null and response is not null""")
def reference_preserved(spark, d):
    x = _ctx(spark, d).where("instruction is not null and response is not null")
    return x.select("id", rules.numbers_kept(F.col("instruction"), F.col("response")).alias("kept"), rules.has_control_marks(F.col("response")).alias("control"))


@query("""select id, '<|im_start|>system' || chr(10) || 'You are a support assistant.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || instruction || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || response || '<|im_end|>' || chr(10) chat from augmentation_context""")
def chat_rendering(spark, d):
    return _ctx(spark, d).select("id", rules.chat_text("You are a support assistant.", F.col("instruction"), F.col("response")).alias("chat"))


@query("""select id, position, batch, max(n_tokens) over (partition by batch) padded from (select id, n_tokens, row_number() over (order by id) - 1 as position, (row_number() over (order by id) - 1) // 16 as batch from augmentation_context)""")
def padded_lengths(spark, d):
    x = profile.batches(_ctx(spark, d).select("id", "n_tokens"), F.col("id"), 16)
    width = x.groupBy("batch").agg(F.max("n_tokens").alias("padded"))
    return x.join(width, "batch").select("id", F.col("position").cast("long").alias("position"), F.col("batch").cast("long").alias("batch"), "padded")


# --- joins ----------------------------------------------------------------------------------------------------------


@query("""with a as (select id, count(*) n from raw_answers where model = 'base' group by id), b as (select id, count(*) n from scenarios group by id)
select key, problem from (select coalesce(a.id, b.id) as key, case when b.id is null then 'missing_right' when a.id is null then 'missing_left' when a.n > 1 then 'repeated_left' when b.n > 1 then 'repeated_right' end problem
from a full outer join b on a.id = b.id) where problem is not null""")
def align_violations(spark, d):
    return joins.align_violations(_ans(spark, d).where("model = 'base'"), _items(spark, d), "id")


@query("""with t as (select distinct tag from raw_answers), a as (select id, max(answer_id) last from raw_answers where error is null group by id)
select s.id from scenarios s where not exists (select 1 from a where a.id = s.id)""")
def resume_todo(spark, d):
    return streaming.resume(_items(spark, d).select("id"), _ans(spark, d).where("error is null"), "id")


@query(f"""with bad as (select distinct id from ({SQL['leak_sixgram_screen']}) where not pass), g as (select distinct group_id from augmentation_context join bad using (id) where group_id is not null)
select id from augmentation_context a where not (id in (select id from bad) and group_id is null) and (group_id is null or group_id not in (select group_id from g))""")
def purge_leaking_groups(spark, d):
    t = _ctx(spark, d)
    return joins.purge_groups(t, "group_id", leak_sixgram_screen(spark, d).where("not pass"), "id").select("id")


@query(f"""with v as (select distinct {_norm('instruction')} v, {_SPLIT_SQL} s from augmentation_context where instruction is not null and split is not null)
select a.s || '/' || b.s pair, count(*) n_values from v a join v b on a.v = b.v and a.s < b.s group by 1""")
def split_intersections(spark, d):
    return joins.split_intersections(_ctx(spark, d).withColumn("s", _split()), X.normalize_ascii(F.col("instruction")), "s")


@query(f"select group_id grp, count(distinct {_SPLIT_SQL}) n_splits from augmentation_context where group_id is not null and split is not null group by group_id having count(distinct {_SPLIT_SQL}) > 1")
def straddling_groups(spark, d):
    return joins.straddling_groups(_ctx(spark, d).withColumn("s", _split()), F.col("group_id"), "s")


_LIST = ["ch2-204", "ch2-001", "ch2-500", "ch2-033"]


@query("select s.id, s.query, l.position::int as position from scenarios s join (select unnest(['ch2-204', 'ch2-001', 'ch2-500', 'ch2-033']) id, unnest([0, 1, 2, 3]) as position) l using (id)")
def ordered_selection(spark, d):
    return joins.select_in_order(_items(spark, d).select("id", "query"), "id", _LIST)


@query("""with b as (select id, max(latency_ms) v from raw_answers where model = 'base' and id is not null group by id), t as (select id, max(latency_ms) v from raw_answers where model = 'tuned' and id is not null group by id)
select coalesce(b.id, t.id) id, coalesce(b.v, t.v) v, case when b.v is not null then 'first' else 'second' end origin, b.v is not null and t.v is not null both_sides from b full outer join t on b.id = t.id""")
def precedence_merge(spark, d):
    a = _ans(spark, d).where("id is not null")
    side = lambda m: a.where(F.col("model") == m).groupBy("id").agg(F.max("latency_ms").alias("v"))
    return joins.prefer(side("base"), side("tuned"), "id", "v").withColumnRenamed("both", "both_sides")


@query("select c.id, i.category as expected, i.category is not distinct from c.category as same from augmentation_context c left join intents i on i.intent = " + _INTENT_SQL.replace("intent", "c.intent"))
def category_lookup(spark, d):
    c = _ctx(spark, d).select("id", _intent().alias("intent"), "category")
    i = table(spark, d, "intents").select("intent", F.col("category").alias("expected"))
    return c.join(i, "intent", "left").select("id", "expected", F.col("expected").eqNullSafe(F.col("category")).alias("same"))


# --- vectors --------------------------------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::double * p[2]::double))"


@query(f"select vec_id, nearest, similarity from (select a.vec_id, b.vec_id nearest, round({_DOT}, 6) similarity, row_number() over (partition by a.vec_id order by round({_DOT}, 9) desc, b.vec_id) r from embeddings a join embeddings b on a.vec_id <> b.vec_id) where r = 1")
def cosine_nearest(spark, d):
    return joins.nearest(_vec(spark, d), _vec(spark, d), "vec_id", "embedding")


@query(f"select vec_id, nearest, similarity from (select a.vec_id, b.vec_id nearest, round({_DOT}, 6) similarity, row_number() over (partition by a.vec_id order by round({_DOT}, 9) desc, b.vec_id) r from embeddings a join embeddings b on a.vec_id <> b.vec_id and a.label = b.label) where r = 1")
def cosine_nearest_within_label(spark, d):
    return joins.nearest(_vec(spark, d), _vec(spark, d), "vec_id", "embedding", within=F.col("label"))


_PAIRS = f"select a.label, a.vec_id a, b.vec_id b, round({_DOT}, 6) similarity from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id"


@query(f"select * from ({_PAIRS}) where similarity >= 0.3")
def cosine_pairs_over_t(spark, d):
    return joins.similar_pairs(_vec(spark, d), "vec_id", "embedding", 0.3, "label")


_EDGES = [0.0, 0.1, 0.2, 0.3, 0.4, 1.0]


@query(f"""select band, count(*) n from (select case when similarity >= 0.0 and similarity < 0.1 then '0.00-0.10' when similarity >= 0.1 and similarity < 0.2 then '0.10-0.20' when similarity >= 0.2 and similarity < 0.3 then '0.20-0.30'
when similarity >= 0.3 and similarity < 0.4 then '0.30-0.40' when similarity >= 0.4 and similarity < 1.0 then '0.40-1.00' end band from ({_PAIRS})) where band is not null group by band""")
def cosine_bands(spark, d):
    p = joins.similar_pairs(_vec(spark, d), "vec_id", "embedding", -1.0, "label")
    return p.select(joins.band(F.col("similarity"), _EDGES).alias("band")).where("band is not null").groupBy("band").agg(F.count("*").alias("n"))


_NEAR = f"select a.vec_id, arg_max(a.label = b.label, (round({_DOT}, 9), -b.vec_id)) same, max(round({_DOT}, 6)) similarity from embeddings a join embeddings b on a.vec_id <> b.vec_id group by a.vec_id"
_T = [0.1, 0.2, 0.3, 0.4, 0.5]


@query(f"""with p as ({_NEAR}), t as (select unnest([0.1, 0.2, 0.3, 0.4, 0.5])::double threshold),
c as (select threshold, count(*) filter (similarity >= threshold and same) tp, count(*) filter (similarity >= threshold and not same) fp, count(*) filter (similarity < threshold and same) fn, count(*) filter (similarity < threshold and not same) tn from p, t group by threshold)
select *, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall from c""")
def threshold_confusion(spark, d):
    v = _vec(spark, d).select("vec_id", "label")
    near = joins.nearest(_vec(spark, d), _vec(spark, d), "vec_id", "embedding")
    other = v.select(F.col("vec_id").alias("nearest"), F.col("label").alias("l2"))
    p = near.join(v, "vec_id").join(other, "nearest").select("similarity", (F.col("label") == F.col("l2")).alias("same"))
    return profile.confusion_at(p, "similarity", "same", _T)


@query("with t as (" + SQL["threshold_confusion"] + """) select coalesce(min(threshold) filter (fp = 0 and tp > 0 and (fn + tn = 0 or tn >= 0.5 * (fn + tn))), min(threshold) filter (fp = 0 and tp > 0), max(threshold) filter (tp + fp > 0), max(threshold)) threshold,
case when count(*) filter (fp = 0 and tp > 0 and (fn + tn = 0 or tn >= 0.5 * (fn + tn))) > 0 then 'clean_and_mostly_different_below' when count(*) filter (fp = 0 and tp > 0) > 0 then 'clean' else 'most_conservative' end "rule" from t""")
def threshold_pick(spark, d):
    return profile.pick_threshold(threshold_confusion(spark, d))


@query(f"""with recursive e as (select a, b from ({_PAIRS}) where similarity >= 0.35), u as (select a, b from e union select b, a from e),
r(n, m) as (select vec_id, vec_id from embeddings union select u.b, r.m from r join u on r.n = u.a where r.m < u.b)
select v.vec_id, v.label, min(r.m) root from embeddings v join r on r.n = v.vec_id group by 1, 2""")
def single_link_clusters(spark, d):
    return grouping.single_linkage(_vec(spark, d), "vec_id", "embedding", "label", 0.35)


@query()
def average_link_clusters(spark, d):
    return grouping.average_linkage(_vec(spark, d), "vec_id", "embedding", "label", 0.35)


@query("select case when count(*) filter (near_collapse) = 0 then 'single' else 'average' end linkage from (" + SQL["group_stats"] + ")")
def linkage_choice(spark, d):
    return grouping.recommend_linkage(group_stats(spark, d))


@query("""select vec_id, case when embedding is null then 'missing' when len(embedding) <> 64 then 'size' when abs(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) - 1) > 0.001 then 'not_unit' end problem from embeddings
where embedding is null or len(embedding) <> 64 or abs(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) - 1) > 0.001""")
def vector_cache_check(spark, d):
    return sources.vector_problems(_vec(spark, d), "vec_id", "embedding")


# --- grouping and selection -----------------------------------------------------------------------------------------

_KEYS = f"select id, intent, {_norm('instruction')} norm from augmentation_context where instruction is not null"


@query(f"""with k as ({_KEYS}), m as (select intent, norm, min(id) m from k where norm <> '' group by intent, norm)
select k.id, coalesce(m.m, k.id) root from k left join m on k.intent is not distinct from m.intent and k.norm = m.norm""")
def group_exact_components(spark, d):
    t = _ctx(spark, d).where("instruction is not null").select("id", "intent", X.normalize_ascii(F.col("instruction")).alias("norm"))
    return grouping.exact_groups(t, "id", F.col("norm"), "intent")


@query(f"""with k as ({_KEYS}), m as (select intent, norm, min(id) m from k where norm <> '' group by intent, norm),
r as (select k.id, k.intent, coalesce(m.m, k.id) root from k left join m on k.intent is not distinct from m.intent and k.norm = m.norm),
g as (select intent, root, row_number() over (order by intent nulls first, root) - 1 n from (select distinct intent, root from r))
select r.id, 'g-' || lpad(g.n::varchar, 6, '0') group_new from r join g on r.intent is not distinct from g.intent and r.root = g.root""")
def group_ids(spark, d):
    t = _ctx(spark, d).where("instruction is not null").select("id", "intent", X.normalize_ascii(F.col("instruction")).alias("norm"))
    g = t.select("id", "intent").join(grouping.exact_groups(t, "id", F.col("norm"), "intent"), "id")
    return grouping.group_ids(g, "intent").select("id", "group_new")


_HASH = "md5('42:' || group_id)"


@query(f"""with g as (select distinct intent, group_id from augmentation_context where group_id is not null),
r as (select *, row_number() over (partition by intent order by {_HASH}, group_id) r, count(*) over (partition by intent) n from g),
c as (select *, greatest(round_even(n * 0.1, 0)::int, 1) t from r),
k as (select *, case when n <= 2 then 0 when n - 2 * t < 1 then (n - 1) // 2 else t end val, case when n <= 1 then 0 when n = 2 then 1 when n - 2 * t < 1 then n - 1 - (n - 1) // 2 else t end test from c)
select intent, group_id, case when r <= n - val - test then 'train' when r <= n - test then 'val' else 'test' end split_new from k""")
def split_groups_hash(spark, d):
    return selection.split_groups(_ctx(spark, d), "intent", "group_id")


@query("""with f as (select intent, group_id, md5('v3:' || id) o, id, row_number() over (partition by intent, group_id order by md5('v3:' || id), id) r from augmentation_context)
select intent, group_id, id, r2::int r from (select *, row_number() over (partition by intent order by o, id) r2 from f where r = 1) where r2 <= 5""")
def quota_select_distinct_groups(spark, d):
    return selection.quota(_ctx(spark, d), "intent", "group_id", "id", 5, "v3")


@query("""select intent, id, r::int r from (select intent, id, row_number() over (partition by intent order by md5('val:' || id), id) r from augmentation_context) order by r, intent nulls first limit 100""")
def interleaved_sample(spark, d):
    return selection.interleave(_ctx(spark, d), "intent", "id", 100, "val")


@query("select id, row_number() over (order by md5('blind:' || id), id) <= count(*) over () // 2 base_first from scenarios")
def blind_sides(spark, d):
    return selection.balanced_sides(_items(spark, d), "id", "blind")


@query("select id, ('0x' || substr(md5('coin:' || id), 1, 1))::int % 2 = 0 base_first, md5('coin:place:' || id) place from scenarios")
def coin_sides(spark, d):
    return selection.coin_sides(_items(spark, d), "id", "coin")


@query()
def cap_whole_groups(spark, d):
    t = _ctx(spark, d)
    return selection.cap_groups(t, "intent", "group_id", max(1, t.count() // 2)).select("id", "intent", "group_id")


@query()
def greedy_gram_dedup(spark, d):
    t = _ctx(spark, d).where("instruction is not null").select("intent", "id", X.ngrams(X.tokens(F.col("instruction"))).alias("g"))
    return selection.greedy_gram_dedup(t, "intent", "id", "g")


@query("select id, row_number() over (order by md5('epoch:' || id), id) - 1 as position, (row_number() over (order by md5('epoch:' || id), id) - 1) // 32 as batch from augmentation_context")
def epoch_batches(spark, d):
    x = profile.batches(_ctx(spark, d).select("id"), F.struct(X.hash_order("epoch", F.col("id")), "id"), 32)
    return x.select("id", F.col("position").cast("long").alias("position"), F.col("batch").cast("long").alias("batch"))


# --- evaluation -----------------------------------------------------------------------------------------------------

_PAIRED = """with l as (select id, model, arg_max(answer is not null and trim(answer) <> '' and not coalesce(truncated, false) and error is null, answer_id) ok from raw_answers where model in ('base', 'tuned') and id is not null group by 1, 2),
p as (select id, max(ok::int) filter (model = 'base') b, max(ok::int) filter (model = 'tuned') t from l group by id),
pairs as (select s.id, s.intent, s.kind, coalesce(b, 0) = 1 base_pass, coalesce(t, 0) = 1 tuned_pass, b is not null and t is not null observed,
case when coalesce(b, 0) > coalesce(t, 0) then 'base' when coalesce(t, 0) > coalesce(b, 0) then 'tuned' else 'tie' end preferred from scenarios s left join p using (id)) """


def _pairs(spark, d):
    return plans.paired_answers(_ans(spark, d), _items(spark, d))


@query(_PAIRED + "select * from pairs")
def paired_scores(spark, d):
    return _pairs(spark, d)


@query(_PAIRED + """select field, value, count(*) n, count(*) filter (base_pass) base_passes, count(*) filter (tuned_pass) tuned_passes, round((count(*) filter (tuned_pass) - count(*) filter (base_pass)) * 100.0 / count(*), 6) points
from (select *, 'all' field, 'all' as value from pairs union all select *, 'intent', coalesce(intent, '') from pairs union all select *, 'kind', coalesce(kind, '') from pairs) group by 1, 2""")
def paired_breakdown(spark, d):
    return profile.paired_breakdown(_pairs(spark, d), ["intent", "kind"])


@query(_PAIRED + """select count(*) strata, round(avg(b) * 100, 6) base_macro, round(avg(t) * 100, 6) tuned_macro, round((avg(t) - avg(b)) * 100, 6) points, sum(g)::bigint gains, sum(l)::bigint losses, sum(n - g - l)::bigint ties
from (select intent, avg(base_pass::int) b, avg(tuned_pass::int) t, count(*) filter (tuned_pass and not base_pass) g, count(*) filter (base_pass and not tuned_pass) l, count(*) n from pairs group by intent)""")
def macro_summary(spark, d):
    return profile.macro_summary(_pairs(spark, d), "intent")


@query(_PAIRED + """select count(*) n, count(*) filter (not observed) missing, round((sum(case when observed then tuned_pass::int - base_pass::int else 0 end) - count(*) filter (not observed)) * 100.0 / count(*), 6) worst,
round((sum(case when observed then tuned_pass::int - base_pass::int else 0 end) + count(*) filter (not observed)) * 100.0 / count(*), 6) best from pairs""")
def missing_bounds(spark, d):
    return profile.missing_bounds(_pairs(spark, d), F.col("observed"))


@query(_PAIRED + "select id, intent, kind from pairs where not tuned_pass or preferred = 'base'")
def paired_failures(spark, d):
    return _pairs(spark, d).where("not tuned_pass or preferred = 'base'").select("id", "intent", "kind")


@query(_PAIRED + """, c as (select intent, sum(tuned_pass::int - base_pass::int)::double s, count(*) n, row_number() over (order by intent nulls first) - 1 i from pairs group by intent), k as (select count(*) k from c),
slots as (select b, ('0x' || substr(md5('boot:' || b || ':' || c.i), 1, 8))::bigint % k.k i from c, k, range(1, 501) t(b)),
m as (select b, sum(s) / sum(n) m from slots join c using (i) group by b)
select (select round(sum(s) / sum(n), 6) from c) estimate, round(quantile_cont(m, 0.025), 6) low, round(quantile_cont(m, 0.975), 6) high from m""")
def bootstrap_clusters(spark, d):
    p = _pairs(spark, d).withColumn("diff", F.col("tuned_pass").cast("int") - F.col("base_pass").cast("int"))
    return stats.bootstrap_hash(stats.reduce_clusters(p, "intent", "diff"), 500, "boot")


@query()
def rouge_l_pairs(spark, d):
    a = _ans(spark, d).where("answer is not null").join(_items(spark, d).select("id", "facts"), "id").where("facts is not null")
    return a.select("answer_id", F.round(X.rouge_l(F.col("answer"), F.col("facts")), 6).alias("rouge_l"))


# --- constraints ----------------------------------------------------------------------------------------------------


@query("""select rule_id, count(*) n from (select unnest(list_filter([case when not coalesce(regexp_full_match(id, '(?:ch2|ch)-\\d{3}'), false) then 'id_form' end, case when not coalesce(kind in ('ordinary', 'hard'), false) then 'kind' end,
case when query is null or trim(query) = '' then 'query_blank' end, case when facts is null or trim(facts) = '' then 'facts_blank' end, case when coalesce(len(acceptable_actions) < 1, true) then 'actions' end, case when coalesce(len(critical_fail_if) < 1, true) then 'critical' end,
case when max_bitext_cosine is null or isnan(max_bitext_cosine) or max_bitext_cosine < 0 or max_bitext_cosine > 1 then 'cosine_range' end, case when max_bitext_cosine >= 0.85 then 'cosine_cap' end, case when not coalesce(demo = false, false) then 'demo' end, case when regexp_matches(concat_ws(chr(10), query, facts), '<\\|(im_start|im_end|endoftext)\\|>') then 'control_mark' end], lambda x: x is not null)) rule_id from scenarios) group by rule_id""")
def scenario_violations(spark, d):
    v = validate.row_violations(_items(spark, d), "id", validate.scenario_rules())
    return v.groupBy("rule_id").agg(F.count("*").alias("n"))


@query("""select unnest(list_filter([case when contains(concat_ws(chr(10), instruction, response), '{{') then 'slot_left' end, case when n_tokens > 512 then 'over_length' end, case when instruction is null then 'instruction_missing' end,
case when response is null then 'response_missing' end], lambda x: x is not null)) rule_id, id row_key, '' detail from augmentation_context""")
def training_violations(spark, d):
    return validate.row_violations(_ctx(spark, d), "id", validate.training_rules())


@query("select 'quota' rule_id, intent || '/' || kind row_key, count(*)::varchar detail from scenarios group by intent, kind having count(*) <> 18")
def quota_violations(spark, d):
    return validate.quota_per(_items(spark, d), ["intent", "kind"], 18)


@query(f"select 'not_covered' rule_id, intent row_key, '' detail from intents where intent not in (select {_INTENT_SQL} from augmentation_context where intent is not null and {_SPLIT_SQL} = 'val')")
def intent_coverage(spark, d):
    return validate.coverage(_ctx(spark, d).where(_split() == "val"), _intent(), table(spark, d, "intents").select("intent"))


_JOURNAL = """select user_id::varchar item_id, row_number() over (partition by user_id, event_type order by event_id)::int attempt, case when event_type in ('view', 'click') then 'started' else 'finished' end as event, case when value > 50 then 'valid' else 'invalid' end status from events"""


def _journal(spark, d):
    """The event table read as a journal: attempts numbered per user and type."""
    from pyspark.sql import Window as W

    e = table(spark, d, "events")
    n = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("event_id"))
    kind = F.when(F.col("event_type").isin("view", "click"), "started").otherwise("finished")
    return e.select(F.col("user_id").cast("string").alias("item_id"), n.alias("attempt"), kind.alias("event"), F.when(F.col("value") > 50, "valid").otherwise("invalid").alias("status"))


@query(f"""with j as ({_JOURNAL}), a as (select item_id, attempt, count(*) filter (event = 'started') s, count(*) filter (event = 'finished') f, max(status) filter (event = 'finished') status from j group by 1, 2),
p as (select item_id, count(*) attempts, count(*) filter (f > 0) finished, count(*) filter (s > 0 and f = 0) interrupted, count(*) filter (status = 'valid') v from a group by 1)
select item_id, attempts, finished, interrupted, case when v > 0 then 'done' when interrupted > 0 then 'interrupted' else 'open' end state from p""")
def journal_attempts(spark, d):
    return streaming.attempts(_journal(spark, d))


@query(f"""with j as ({_JOURNAL}), a as (select item_id, attempt, count(*) filter (event = 'started') s, count(*) filter (event = 'finished') f, max(status) filter (event = 'finished') status from j group by 1, 2),
p as (select item_id, count(*) n, max(attempt) last, count(*) filter (s <> 1 or f > 1 or f > s) u, min(attempt) filter (status = 'valid') v from a group by 1)
select unnest(list_filter([case when n <> last then 'attempts_not_contiguous' end, case when u > 0 then 'unpaired_event' end, case when last > v then 'graded_after_valid' end], lambda x: x is not null)) rule_id, item_id row_key, '' detail from p""")
def journal_violations(spark, d):
    return validate.journal_violations(_journal(spark, d))


# --- pipelines, sinks -----------------------------------------------------------------------------------------------


_SLOT_NAME = "regexp_extract_all({}, '\\{{\\{{([^{{}}]+)\\}}\\}}', 1)"

_KEPT = f"""x as (select id, {_INTENT_SQL} intent, coalesce(instruction, '') i, coalesce(response, '') r, coalesce(n_tokens, 0) n from augmentation_context),
y as (select *, regexp_extract_all(i, '\\d+') ni, regexp_extract_all(regexp_extract(r, '(?i)\\b(?:within|in) \\d+ (?:hours?|days?|weeks?)\\b|\\b\\d+ days most likely\\b'), '\\d+') nr, {_SLOT_NAME.format('i')} si, {_SLOT_NAME.format('r')} sr from x),
z as (select *, list_transform(list_concat(si, sr), lambda s: trim(s, E' \\n\\t\\r')) s from y where n <= 512 and trim(i, E' \\n\\t\\r') <> '' and trim(r, E' \\n\\t\\r') <> ''
and not regexp_matches(r, '(?i)\\b(?:i have|i''ve|we have|we''ve) (?:already )?(?:cancelled|canceled|processed|refunded|updated)\\b')
and not (regexp_matches(r, '(?i)\\b(?:within|in) \\d+ (?:hours?|days?|weeks?)\\b|\\b\\d+ days most likely\\b') and not (len(nr) > 0 and list_has_all(ni, nr)))
and not regexp_matches(r, '(?i)\\b(?:send|share|provide|give)\\b.{{0,30}}\\b(?:password|pin|card number)\\b')),
k as (select * from z where len(list_filter(s, lambda v: v = '' or length(v) > 48 or (regexp_matches(v, '\\d') and regexp_matches(v, '(?i)(feature|platform|city|step|channel)')))) = 0)"""
_PREPARED = f"""with recursive {_KEPT}, e0 as (select id, intent, i, r, {_norm('i')} nv, {_norm('r')} tv from k),
st as (select min(id) over (partition by intent, nv) a, id b from e0 where nv <> '' union select min(id) over (partition by intent, tv), id from e0 where tv <> ''), u as (select a, b from st where a <> b union select b, a from st where a <> b),
rr(n, m) as (select id, id from e0 union select u.b, rr.m from rr join u on rr.n = u.a where rr.m < u.b), c as (select n id, min(m) root from rr group by n), g as (select e0.id, e0.intent, e0.nv, e0.i, e0.r, c.root from e0 join c on e0.id = c.id),
gi as (select intent, root, 'g-' || lpad((row_number() over (order by intent nulls first, root) - 1)::varchar, 6, '0') group_new from (select distinct intent, root from g)),
sr as (select *, row_number() over (partition by intent order by md5('42:' || group_new), group_new) r, count(*) over (partition by intent) n from gi), sc as (select *, greatest(round_even(n * 0.1, 0)::int, 1) t from sr),
sk as (select *, case when n <= 2 then 0 when n - 2 * t < 1 then (n - 1) // 2 else t end val, case when n <= 1 then 0 when n = 2 then 1 when n - 2 * t < 1 then n - 1 - (n - 1) // 2 else t end test from sc),
ss as (select intent, root, group_new, case when r <= n - val - test then 'train' when r <= n - test then 'val' else 'test' end split_new from sk),
p as (select g.id, g.intent, ss.group_new, ss.split_new, g.nv, g.i, g.r from g join ss on g.root = ss.root and g.intent is not distinct from ss.intent) """


@query(_PREPARED + "select id, intent, group_new, split_new from p")
def prepare_pipeline(spark, d):
    out, _ = plans.prepare(_ctx(spark, d).withColumn("intent", _intent()))
    return out.select("id", "intent", "group_new", "split_new")


@query(_PREPARED + """, v as (select count(distinct split_new) s from p where nv <> '' group by concat_ws(':', intent, nv))
select 'shared_instructions' "check", coalesce(sum(s * (s - 1) // 2), 0)::bigint n from v union all select 'straddling_groups', count(*) from (select group_new from p group by 1 having count(distinct split_new) > 1) union all
select 'slots_left', count(*) filter (contains(regexp_replace(i || chr(10) || r, '\\{\\{([^{}]+)\\}\\}', 'x', 'g'), '{{')) from p""")
def prepare_audit(spark, d):
    out, _ = plans.prepare(_ctx(spark, d).withColumn("intent", _intent()))
    return plans.audit(out)


@query(f"""with {_KEPT} select unnest(['kept', 'kept_with_slots', 'slots_left']) "check", unnest([count(*), count(*) filter (len(s) > 0), count(*) filter (contains(regexp_replace(i || chr(10) || r, '\\{{\\{{([^{{}}]+)\\}}\\}}', 'x', 'g'), '{{{{'))]) n from k""")
def prepare_slots(spark, d):
    """Rows that prepare() keeps, those whose raw texts have a slot, and those with a slot left; the whole SQL is counted
    from the raw rows."""
    out, _ = plans.prepare(_ctx(spark, d).withColumn("intent", _intent()))
    raw = F.concat_ws("\n", "instruction", "response").rlike(X.PLACEHOLDER)
    n = out.agg(F.count("*").alias("kept"), F.count_if(raw).alias("slots"))
    kept = n.select(F.explode(F.array(F.struct(F.lit("kept").alias("check"), F.col("kept").alias("n")), F.struct(F.lit("kept_with_slots").alias("check"), F.col("slots").alias("n")))).alias("x")).select("x.*")
    return kept.unionByName(plans.audit(out).where("check = 'slots_left'"))


@query("select id, sha256(query) hash from scenarios")
def text_hashes(spark, d):
    return _items(spark, d).select("id", F.sha2("query", 256).alias("hash"))


@query()
def canonical_rows(spark, d):
    return sinks.row_hashes(_items(spark, d))


# --- planning and sheets --------------------------------------------------------------------------------------------

_MOODS = ["calm", "terse", "angry"]


@query("select intent, category, ['calm', 'terse', 'angry'][('0x' || substr(sha256('mood:' || intent), 1, 2))::int % 3 + 1] mood from intents")
def deterministic_pick(spark, d):
    return table(spark, d, "intents").select("intent", "category", sheets.pick_from("mood", F.col("intent"), _MOODS).alias("mood"))


@query("select intent, slot::int slot, case when slot < 5 then 'ordinary' else ['typos', 'anger', 'two_requests', 'no_identifier'][(slot - 5) % 4 + 1] end style from intents, range(10) t(slot)")
def style_plan(spark, d):
    return sheets.style_plan(table(spark, d, "intents").select("intent"), 10, "ordinary", ["typos", "anger", "two_requests", "no_identifier"])


_SIDE = "select id, arg_max(answer, answer_id) filter (answer is not null) answer from raw_answers where id is not null and model = '{}' group by id"


@query(f"""with s as (select id, row_number() over (order by md5('blind:' || id), id) <= count(*) over () // 2 f from scenarios), b as ({_SIDE.format('base')}), t as ({_SIDE.format('tuned')}),
x as (select s.id, case when f then b.answer else t.answer end a, case when f then t.answer else b.answer end c from s left join b on s.id = b.id left join t on s.id = t.id)
select id, case when a is null or trim(a) = '' then '[no answer]' else a end "answer_A", case when c is null or trim(c) = '' then '[no answer]' else c end "answer_B", case when a is null or trim(a) = '' then 'false' else '' end "pass_A", case when c is null or trim(c) = '' then 'false' else '' end "pass_B" from x""")
def judgment_sheet(spark, d):
    a = _ans(spark, d).where("id is not null and answer is not null")
    side = lambda m: a.where(F.col("model") == m).groupBy("id").agg(F.max_by("answer", "answer_id").alias("answer"))
    return sheets.judgment_sheet(_items(spark, d), side("base"), side("tuned"), selection.balanced_sides(_items(spark, d), "id", "blind"))


@query("with f as (select distinct intent, group_id, md5('42:' || group_id) from augmentation_context where group_id is not null) select id, c.group_id, g.split_new from augmentation_context c join (" + SQL["split_groups_hash"] + ") g on c.group_id = g.group_id and c.intent is not distinct from g.intent")
def frozen_restore(spark, d):
    g = split_groups_hash(spark, d).select(F.coalesce("intent", F.lit("<null>")).alias("s"), "group_id", "split_new")
    c = _ctx(spark, d).where("group_id is not null").select("id", F.coalesce("intent", F.lit("<null>")).alias("s"), "group_id")
    return c.join(g, ["s", "group_id"]).select("id", "group_id", "split_new")


@query("""with v as (select sha256(instruction) text_hash, intent, max(split) verdict from augmentation_context where instruction is not null and intent is not null group by 1, 2)
select c.id, v.verdict from augmentation_context c left join v on sha256(c.instruction) = v.text_hash and c.intent = v.intent""")
def verdict_reuse(spark, d):
    t = _ctx(spark, d)
    v = t.where("instruction is not null and intent is not null").groupBy(F.sha2("instruction", 256).alias("text_hash"), "intent").agg(F.max("split").alias("verdict"))
    return sheets.reuse_verdicts(t.select("id", "intent", "instruction"), "instruction", "intent", v).select("id", "verdict")


@query("""with s as (select date_trunc('day', ingested_at)::date::varchar step, model, avg(latency_ms) v from raw_answers where ingested_at is not null group by 1, 2)
select count(*) steps, round(max(abs(a.v - b.v)), 6) largest_difference, max(a.step) last_step, max(abs(a.v - b.v)) <= 100 same from s a join s b on a.step = b.step and a.model = 'base' and b.model = 'tuned'""")
def series_comparison(spark, d):
    s = _ans(spark, d).where("ingested_at is not null").groupBy(F.to_date("ingested_at").cast("string").alias("step"), "model").agg(F.avg("latency_ms").alias("v"))
    return sheets.compare_series(s.where("model = 'base'"), s.where("model = 'tuned'"), "step", "v", 100.0)


@query("select id, coalesce(facts, '') facts, coalesce(array_to_string(acceptable_actions, '; '), '') actions, coalesce(array_to_string(critical_fail_if, '; '), '') critical from scenarios")
def rubric_projection(spark, d):
    return sheets.rubric(_items(spark, d))


@query("select intent, reason, count(*) n from (select intent, unnest(cleaning) reason from augmentation_context) group by 1, 2")
def reason_counts(spark, d):
    return sheets.reason_counts(_ctx(spark, d), "intent", F.col("cleaning"))


@query("select intent, min(n_tokens) least, max(n_tokens) most, count(distinct response) unique_targets from augmentation_context group by intent")
def token_stats(spark, d):
    return sheets.token_stats(_ctx(spark, d), ["intent"], "n_tokens", "response")


@query("select id, intent from (select id, intent from scenarios order by id limit 50)")
def head_limit(spark, d):
    """A limited head is the feature here."""
    return _items(spark, d).select("id", "intent").orderBy("id").limit(50)


from corpusloom import queries_more  # noqa: E402,F401  # registers its queries here
