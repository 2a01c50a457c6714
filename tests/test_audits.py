"""Audits, sources, sinks, statistics and joins that SQL over the tables does not reach: odd rows and known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import sources
from corpusloom.operators import audits, grouping, joins, profile, selection, stats
from corpusloom.sources import sinks


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_salted_join_is_an_inner_join(spark):
    left = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(60)], "k int, a int")
    right = spark.createDataFrame([(i % 4, i) for i in range(40)], "k int, b int")
    want = got(left.join(right, "k").select("k", "a", "b"))
    for per_task in (1, 4, 100, 10_000):
        assert got(joins.salted_join(left, right, ["k"], "a", "b", per_task).select("k", "a", "b")) == want
    assert joins.salted_join(left.limit(0), right, ["k"], "a", "b").count() == 0


def test_row_ids_and_sources(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "t string")
    assert got(sources.with_row_ids(df, "x-", ["t"])) == [("a", "x-000000"), ("b", "x-000001"), ("c", "x-000002")]
    assert got(sources.nonempty(spark.createDataFrame([(" a ",)], "t string"), "t")) == [("a",)]
    for bad in ([("",)], [(None,)], []):
        with pytest.raises(ValueError):
            sources.nonempty(spark.createDataFrame(bad, "t string"), "t")
    (tmp_path / "full").write_text("x")
    (tmp_path / "empty").write_text("")
    paths = [str(tmp_path / n) for n in ("full", "empty", "none")]
    assert sources.present(spark, paths) == paths[1:]


def test_comparison_rows(spark):
    df = spark.createDataFrame([("a", "q"), ("a", " "), (None, None)], "id string, query string")
    rows, bad = sources.comparison_rows(df)
    assert got(rows.select("group_id"))[-1] == (None,) or rows.count() == 3
    assert {r.rule_id for r in bad.collect()} == {"blank_id", "repeated_id", "missing_query", "invalid_group"}
    assert sources.comparison_rows(spark.createDataFrame([("a", None, "q")], "id string, instruction string, query string"))[1].first().rule_id == "missing_query"


def test_bad_lines_name_their_file(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n[1]\n')
    _, bad = sources.jsonl_strict(spark, str(tmp_path / "x.jsonl"), T.StructType([T.StructField("id", T.StringType())]))
    r = bad.first()
    assert r.value == "[1]" and r.path.endswith("x.jsonl")


def test_chunks_and_reports(spark):
    df = spark.createDataFrame([(1, "a" * 25), (2, ""), (3, "häß")], "k int, t string")
    parts = sinks.chunks(df, "k", "t", 10)
    assert parts.where("k = 1").count() == 3
    assert got(sinks.reassembled(parts, "k")) == [(1, "a" * 25, True), (2, "", True), (3, "häß", True)]
    lost = sinks.reassembled(parts.where("not (k = 1 and part = 1)"), "k").where("k = 1").first()
    assert not lost.intact
    assert sinks.markdown_table(spark.createDataFrame([(2, "a|b"), (1, None)], "n int, t string"), ["n"]) == "| n | t |\n|---|---|\n| 1 |  |\n| 2 | a\\|b |\n"
    assert "<" not in sinks.html_rows(spark.createDataFrame([("</script>",)], "t string")).first().value


def test_bootstrap_of_items_and_strata(spark):
    rng = np.random.default_rng(4)
    rows = [(f"i{k:03d}", f"s{k % 5}", int(rng.integers(-1, 2))) for k in range(60)]
    r = stats.paired_bootstrap_exact(spark.createDataFrame(rows, "id string, s string, d int"), "id", "s", "d", 300, 7)
    by = [np.mean([v for _, s, v in rows if s == f"s{j}"]) for j in range(5)]
    g = np.random.default_rng(7)
    macro = np.array(by)[g.integers(0, 5, size=(300, 5))].mean(axis=1) * 100
    items = np.array([v for _, _, v in rows], float)
    second = items[g.integers(0, 60, size=(300, 60))].mean(axis=1) * 100
    assert r["macro"] == pytest.approx((np.mean(by) * 100, *np.quantile(macro, [0.025, 0.975])))
    assert r["items"] == pytest.approx((items.mean() * 100, *np.quantile(second, [0.025, 0.975])))
    assert stats.paired_bootstrap_exact(spark.createDataFrame([], "id string, s string, d int"), "id", "s", "d") == {}


def test_threshold_falls_back(spark):
    cols = "threshold double, tp long, fp long, fn long, tn long"
    pick = lambda rows: tuple(profile.pick_threshold(spark.createDataFrame(rows, cols)).first())
    assert pick([(0.5, 3, 1, 0, 2), (0.6, 3, 0, 2, 1), (0.7, 2, 0, 1, 3)]) == (0.7, "clean_and_mostly_different_below")
    assert pick([(0.6, 3, 0, 2, 1), (0.7, 2, 0, 3, 1)]) == (0.6, "clean")
    assert pick([(0.6, 3, 1, 0, 0), (0.7, 1, 1, 0, 0), (0.8, 0, 0, 1, 1)]) == (0.7, "most_conservative")
    assert pick([(0.8, 0, 0, 1, 1)]) == (0.8, "most_conservative")


def test_exempt_rows_beyond_the_cap(spark):
    df = spark.createDataFrame([("a", f"g{k}", k < 6) for k in range(12)], "s string, g string, x boolean")
    assert selection.cap_groups(df, "s", "g", 8, exempt=F.col("x")).count() == 8
    assert selection.cap_groups(df, "s", "g", 6, exempt=F.col("x")).count() == 6
    assert selection.cap_groups(df, "s", "g", 4, exempt=F.col("x")).count() == 4


def test_micro_batches_go_on_at_the_cursor(spark):
    df = spark.createDataFrame([(i,) for i in range(23)], "id int")
    first = selection.micro_batches(df, "id", 5, 4)
    assert first.count() == 20 and first.agg(F.max("cursor")).first()[0] == 4
    assert got(selection.micro_batches(df, "id", 5, 4, 3)) == got(first.where("cursor >= 3"))
    later = selection.micro_batches(df, "id", 5, 4, 7, 1)
    assert got(later.select("cursor", "epoch").distinct()) == [(7, 1)] and later.count() == 4


def test_curated_leaves_out_and_reports(spark):
    df = spark.createDataFrame([("a", "g1", "1", "my order number"), ("a", "g2", "2", "fine"), ("a", "g2", "3", "fine"), ("b", "g3", "4", None)], "s string, g string, id string, t string")
    rows, out, short = selection.curated(df, "s", "g", "id", F.col("t"), 1, "1")
    assert {r.g for r in rows.collect()} == {"g2", "g3"} and got(out) == [("1",)] and short.count() == 0
    assert selection.curated(df, "s", "g", "id", F.col("t"), 2, "1")[2].count() == 2


def test_verdicts_name_every_reason(spark):
    screen = spark.createDataFrame([("a", 0, False), ("b", 2, True), ("c", 0, False)], "id string, n_shared int, exact boolean")
    near = spark.createDataFrame([("a", 0.85), ("b", 0.99), ("x", 1.0)], "id string, similarity double")
    assert got(audits.leak_verdict(screen, near, "id")) == [("a", 0.85, True, ""), ("b", 0.99, False, "exact|shared_grams|cosine"), ("c", None, True, "")]


def test_seals_and_replays(spark):
    h = "0" * 64
    a = spark.createDataFrame([("x", h), ("y", "odd"), ("z", h)], "k string, sha string")
    b = spark.createDataFrame([("x", "1" * 64), ("y", "odd"), ("new", h)], "k string, sha string")
    assert {(r.rule_id, r.row_key) for r in audits.seal_violations(a, b, "k").collect()} == {("changed", "x"), ("not_a_digest", "y"), ("missing", "z"), ("added", "new")}
    p = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 3.0)], "k string, v double, w double")
    q = spark.createDataFrame([("a", 1.0, None), ("b", 2.5, 3.0), ("c", 0.0, 0.0)], "k string, v double, w double")
    assert {(r.rule_id, r.row_key, r.detail) for r in audits.replay_violations(p, q, ["k"], ["v", "w"]).collect()} == {("differs", "b", "v"), ("not_published", "c", "v"), ("not_published", "c", "w")}


def test_exact_groups_of_odd_rows(spark):
    df = spark.createDataFrame([("b", "s", "v"), ("a", "s", "v"), ("c", None, "v"), ("d", None, "v"), ("e", "s", ""), ("f", "s", None)], "id string, s string, v string")
    assert got(grouping.exact_groups(df, "id", F.col("v"), "s")) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e"), ("f", "f")]


def test_gram_sources_count_all_and_name_some(spark):
    text = "one two three four five six"
    held = spark.createDataFrame([(f"h{k:02d}", text) for k in range(30)], "hid string, t string")
    r = joins.gram_sources(spark.createDataFrame([("a", text), ("b", "none")], "id string, t string"), "id", F.col("t"), held, "hid", F.col("t"), most=3).collect()
    assert [(x.id, x.n_sources, x.sources) for x in r] == [("a", 30, "h00,h01,h02")]


def test_similar_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(f"k{i:02d}", v[i].tolist(), None if i % 11 == 0 else f"s{i % 3 == 0}") for i in range(60)] + [("none", None, "sTrue"), (None, v[0].tolist(), "sTrue")]
    df = spark.createDataFrame(rows, "id string, e array<double>, s string")
    want = {(f"k{i:02d}", f"k{j:02d}") for i in range(60) for j in range(i + 1, 60) if rows[i][2] and rows[i][2] == rows[j][2] and round(float(v[i] @ v[j]), 6) >= 0.2}
    for block in (1, 5, 1000):
        got_ = [(r.a, r.b) for r in joins.similar_pairs(df, "id", "e", 0.2, "s", block).collect()]
        assert len(got_) == len(set(got_)) and set(got_) == want
    assert joins.similar_pairs(df.limit(0), "id", "e", 0.2, "s").count() == 0


def test_many_queries_against_a_small_base(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 4))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(40)], "k long, e array<double>")
    near = {r.k: r.nearest for r in joins.nearest(df, df.where("k < 3"), "k", "e", block=4).collect()}
    for i in range(40):
        sims = [(round(float(v[i] @ v[j]), 9), -j) for j in range(3) if j != i]
        assert near[i] == -max(sims)[1]
