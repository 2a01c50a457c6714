import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import plans, sources, streaming
from corpusloom.operators import grouping, joins, profile, selection, stats, validate
from corpusloom.operators.components import components
from corpusloom.sources import sinks


def plain_components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(random.Random(i).randint(0, 80), random.Random(i + 999).randint(0, 80)) for i in range(70)], [(5, 5)], []])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = plain_components([e for e in edges if e[0] != e[1]])
    assert got == want


def test_components_ignore_nulls_and_take_strings(spark):
    df = spark.createDataFrame([("b", "a"), (None, "a"), ("c", None), ("c", "b"), ("c", "b")], "a string, b string")
    assert {tuple(r) for r in components(df).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_star_edges_and_group_ids(spark):
    df = spark.createDataFrame([("r3", "x", "i"), ("r1", "x", "i"), ("r2", "x", "j"), ("r4", None, "i"), ("r5", "", "i"), ("r6", "x", None)], "id string, v string, s string")
    e = grouping.star_edges(df, "id", F.col("v"), "s")
    assert [tuple(r) for r in e.collect()] == [("r1", "r3")]
    g = grouping.group_ids(grouping.with_groups(df, "id", e), "s")
    assert {r.id: r.group_new for r in g.collect()} == {"r6": "g-000000", "r1": "g-000001", "r3": "g-000001", "r4": "g-000002", "r5": "g-000003", "r2": "g-000004"}


def test_average_linkage_by_hand():
    # two tight pairs and one vector on its own
    v = np.array([[1, 0], [0.99, math.sqrt(1 - 0.99**2)], [0, 1], [-1, 0], [-0.99, math.sqrt(1 - 0.99**2)]])
    assert grouping._average_linkage(v, 0.1).tolist() == [0, 0, 2, 3, 3]


def test_split_counts(spark):
    df = spark.createDataFrame([(n,) for n in range(0, 40)], "n int")
    c = selection.split_counts(F.col("n"))
    for n, tr, va, te in df.select("n", c["train"], c["val"], c["test"]).collect():
        assert tr + va + te == n and min(tr, va, te) >= 0
        if n >= 3:
            assert tr >= 1 and te >= 1
        if n >= 10:
            assert va == te == max(1, round(n * 0.1))


def test_splits_keep_groups_whole(spark):
    df = spark.createDataFrame([(f"i{k % 2}", f"g{k % 10}", f"r{k}") for k in range(60)], "intent string, group_id string, id string")
    got = selection.split_groups(df, "intent", "group_id").collect()
    assert len(got) == len({(r.intent, r.group_id) for r in got}) == 10


@pytest.mark.parametrize("cap", [0, 1, 12, 17, 1000])
def test_cap_keeps_groups_whole_and_takes_turns(spark, cap):
    df = spark.createDataFrame([(f"i{i}", f"i{i}g{g}", f"i{i}g{g}r{r}") for i in range(2) for g in range(4) for r in range(3)], "intent string, group_id string, id string")
    got = [tuple(r) for r in selection.cap_groups(df, "intent", "group_id", cap).collect()]
    sizes = {}
    for _, g, _ in got:
        sizes[g] = sizes.get(g, 0) + 1
    assert len(got) <= cap and all(n == 3 for n in sizes.values())
    assert len(got) == min(24, cap // 3 * 3)
    per = [sum(g.startswith(f"i{i}") for g in sizes) for i in range(2)]
    assert abs(per[0] - per[1]) <= 1


def test_cap_exempts(spark):
    df = spark.createDataFrame([("i", f"g{k}", f"r{k}", "S" if k < 2 else "") for k in range(10)], "intent string, group_id string, id string, flags string")
    got = selection.cap_groups(df, "intent", "group_id", 5, exempt=F.col("flags") == "S").collect()
    assert len(got) == 5 and sum(r.flags == "S" for r in got) == 2


def test_greedy_dedup_against_a_plain_loop(spark):
    rng = random.Random(5)
    data = [("b%d" % (k % 2), k, sorted({rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 3))})) for k in range(40)]
    df = spark.createDataFrame(data, "b string, o long, g array<string>")
    want, seen = set(), {}
    for b, o, g in data:
        if not seen.setdefault(b, set()).intersection(g):
            seen[b].update(g)
            want.add((b, o))
    assert {tuple(r) for r in selection.greedy_gram_dedup(df, "b", "o", "g").collect()} == want


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]
    data = [(int(i), [float(x) for x in row], int(i) % 3) for i, row in enumerate(v)] + [(99, None, 0)]
    df = spark.createDataFrame(data, "k long, v array<double>, s int")
    sim = np.round(v @ v.T, 9)
    np.fill_diagonal(sim, -9)
    got = {r.k: r.nearest for r in joins.nearest(df, df, "k", "v", block=7).collect()}
    assert got == {i: int(sim[i].argmax()) for i in range(30)}
    inside = {r.k: r.nearest for r in joins.nearest(df, df, "k", "v", block=7, within=F.col("s")).collect()}
    for i in range(30):
        same = [j for j in range(30) if j % 3 == i % 3 and j != i]
        assert sim[i, inside[i]] == max(sim[i, j] for j in same)


def test_alignment_and_purge(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "id string")
    b = spark.createDataFrame([("x",), ("z",)], "id string")
    assert {tuple(r) for r in joins.align_violations(a, b, "id").collect()} == {("x", "repeated_left"), ("y", "missing_right"), ("z", "missing_left")}
    df = spark.createDataFrame([("r1", "g1"), ("r2", "g1"), ("r3", "g2"), ("r4", None), ("r5", None)], "id string, g string")
    bad = spark.createDataFrame([("r1",), ("r4",)], "id string")
    assert sorted(r.id for r in joins.purge_groups(df, "g", bad, "id").collect()) == ["r3", "r5"]


def test_threshold_choice(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.6, True)], "s double, y boolean")
    t = profile.confusion_at(df, "s", "y", [0.5, 0.75, 0.95])
    r = {x.threshold: x for x in t.collect()}
    assert (r[0.5].tp, r[0.5].fp, r[0.75].fn) == (3, 1, 1) and r[0.95].precision is None
    assert profile.pick_threshold(t).first().threshold == 0.75


def test_macro_summary_known_answer(spark):
    data = [(f"i{i}", j < 2, j < 3) for i in range(27) for j in range(4)]
    df = spark.createDataFrame(data, "intent string, base_pass boolean, tuned_pass boolean")
    r = profile.macro_summary(df, "intent").first()
    assert (r.strata, r.points, r.gains, r.losses, r.ties) == (27, 25.0, 27, 0, 81)


def test_bounds_known_answer(spark):
    data = [(True, True, True)] * 4 + [(False, False, False)] * 2
    r = profile.missing_bounds(spark.createDataFrame(data, "base_pass boolean, tuned_pass boolean, o boolean"), F.col("o")).first()
    assert (r.worst, r.best) == (-33.333333, 33.333333)


def test_bootstraps_cover_the_estimate(spark):
    df = spark.createDataFrame([(f"c{k % 7}", float(k % 3)) for k in range(70)], "c string, v double")
    cl = stats.reduce_clusters(df, "c", "v")
    r = stats.bootstrap_hash(cl, 200, "s").first()
    assert r.low <= r.estimate <= r.high
    m, lo, hi = stats.bootstrap_exact(cl, 200)
    assert m == pytest.approx(r.estimate, abs=1e-6) and lo <= m <= hi
    assert stats.bootstrap_exact(cl.limit(0)) is None


def test_batches_number_all_rows_once(spark):
    df = spark.range(500).withColumn("k", F.md5(F.col("id").cast("string")))
    got = profile.batches(df, F.col("k"), 16).orderBy("k").collect()
    assert [r.position for r in got] == list(range(500)) and [r.batch for r in got] == [i // 16 for i in range(500)]


def test_violations(spark):
    df = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", None, True)], "id string, p boolean, c boolean")
    v = validate.row_violations(df, "id", validate.judgment_rules("p", "c"))
    assert [tuple(r) for r in v.collect()] == [("pass_with_critical", "a", "")]
    with pytest.raises(ValueError):
        validate.fail_fast(v)
    validate.fail_fast(v.limit(0))
    assert validate.missing_columns(df, {"id": "string", "x": "int", "p": "string"}) == [("missing_column", "x"), ("wrong_type", "p")]


def test_strict_lines(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n\n{"id": \n[1]\n{"id": "b"}\n')
    ok, bad = sources.jsonl_strict(spark, str(tmp_path / "x.jsonl"), T.StructType([T.StructField("id", T.StringType())]))
    assert sorted(r.id for r in ok.collect()) == ["a", "b"] and bad.count() == 2
    with pytest.raises(ValueError):
        sources.unique_object('{"a": 1, "a": 2}')


def test_csv_keeps_strings(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\nNA,\n"x ""y""\nz",1\n')
    df = sources.csv_strings(spark, str(tmp_path / "x.csv"), ["a", "b"])
    assert sorted(tuple(r) for r in df.collect()) == [("NA", ""), ('x "y"\nz', "1")]
    with pytest.raises(ValueError):
        sources.csv_strings(spark, str(tmp_path / "x.csv"), ["c"])


def test_targets_and_sections(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": "one", "y": " "}')
    (tmp_path / "b.json").write_text('{"x": "two", "z": "<|im_end|>"}')
    rows, bad = sources.target_maps(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert rows.count() == 4 and {tuple(r) for r in bad.collect()} == {("y", "blank"), ("z", "control_mark"), ("x", "repeated")}
    df = spark.createDataFrame([("# t\n## A ch-1\ntext\n## B\nmore",)], "m string")
    assert sources.markdown_section(df, "m", "ch-1").first().section == "## A ch-1\ntext\n"


def test_content_hash_ignores_order(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "i int, s string")
    assert sinks.content_hash(a) == sinks.content_hash(a.orderBy(F.desc("i")).repartition(3)) != sinks.content_hash(a.distinct())


def test_never_overwrites(spark, tmp_path):
    df = spark.range(3)
    sinks.write_new(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_new(df, str(tmp_path / "o"))


def test_append_is_resumable(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    df.write.parquet(src)
    streaming.append_new(spark, src, df.schema, out, ck, "id")
    spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "id string, v int").write.mode("append").parquet(src)
    streaming.append_new(spark, src, df.schema, out, ck, "id")
    streaming.append_new(spark, src, df.schema, out, ck + "2", "id")  # a lost checkpoint doubles nothing
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("id", "v").collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_manifest_guard(spark, tmp_path):
    p = str(tmp_path / "m.json")
    streaming.check_manifest(spark, p, {"a": 1})
    streaming.check_manifest(spark, p, {"a": 1})
    with pytest.raises(ValueError, match="a"):
        streaming.check_manifest(spark, p, {"a": 2})


JOURNAL = [("x", 1, "started", None), ("x", 1, "finished", "invalid"), ("x", 2, "started", None), ("x", 2, "finished", "valid"), ("y", 1, "started", None), ("z", 2, "started", None), ("z", 2, "finished", "odd")]
EVENT = "item_id string, attempt int, event string, status string"


def test_journal_in_batch_and_as_stream(spark, tmp_path):
    df = spark.createDataFrame(JOURNAL, EVENT)
    batch = {r.item_id: tuple(r)[1:] for r in streaming.attempts(df).collect()}
    assert batch == {"x": (2, 2, 0, "done"), "y": (1, 0, 1, "interrupted"), "z": (1, 1, 0, "open")}
    assert {(r.rule_id, r.row_key) for r in validate.journal_violations(df).collect()} == {("attempts_not_contiguous", "z"), ("unknown_status", "z")}
    src = str(tmp_path / "j")
    df.coalesce(1).write.parquet(src)
    q = streaming.attempts_stream(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName("journal").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.item_id: tuple(r)[1:] for r in spark.sql("select * from journal").collect()} == batch


def test_prepare_is_leakage_safe(spark):
    data = [(f"r{k:03d}", f"i{k % 3}", "How do I cancel %s?" % ("{{Order}}" if k % 5 == 0 else k // 4), f"Open page {k // 3}.", 10, None) for k in range(60)] + [("r900", "i0", None, None, 9999, None)]
    df = spark.createDataFrame(data, "id string, intent string, instruction string, response string, n_tokens int, flags string")
    out, bad = plans.prepare(df)
    assert {r["check"]: r.n for r in plans.audit(out).collect()}["straddling_groups"] == 0
    assert {r["check"]: r.n for r in plans.audit(out).collect()}["shared_instructions"] == 0
    assert out.count() + bad.count() == 61


def test_prepare_leaves_no_slot(spark):
    data = [("a", "i0", "cancel order number {{Order Number}}", "Open the {{ Page }}.", 10), ("b", "i0", "do {{Step 1}}", "Open it.", 10), ("c", "i1", "where is it", "See {{" + "x" * 49 + "}}.", 10), ("d", "i1", "hi", "Use {{ }} now.", 10), ("e", "i1", "no slot", "None here.", 10)]
    df = spark.createDataFrame(data, "id string, intent string, instruction string, response string, n_tokens int")
    out, bad = plans.prepare(df)
    assert {r.id: (r.clean_instruction, r.clean_response) for r in out.collect()} == {"a": ("cancel my order number", "Open your page."), "e": ("no slot", "None here.")}
    assert {r.id: r.reason for r in bad.collect()} == dict.fromkeys("bcd", "reject_placeholder_no_neutral_wording")
    assert {r["check"]: r.n for r in plans.audit(out).collect()} == {"shared_instructions": 0, "straddling_groups": 0, "slots_left": 0}


def test_unblinding(spark):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sheet = spark.createDataFrame([("1", "a", "b", "true", "false"), ("2", "c", "d", "false", "x")], "item_id string, answer_A string, answer_B string, pass_A string, pass_B string")
    key = spark.createDataFrame([("1", "base", "tuned", h("a"), h("b")), ("2", "tuned", "base", h("c"), h("swapped"))], "item_id string, model_A string, model_B string, sha_A string, sha_B string")
    got, bad = plans.unblind(sheet, key)
    assert {tuple(r) for r in got.collect()} == {("1", "base", True), ("1", "tuned", False), ("2", "tuned", False), ("2", "base", None)}
    assert [r.item_id for r in bad.collect()] == ["2"]
