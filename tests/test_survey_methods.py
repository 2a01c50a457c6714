"""Methods of the survey on small tables with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import grouping, joins, profile, rules, selection, validate


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_artifacts_are_excluded(spark):
    df = spark.createDataFrame([("a", "where is My order number"), ("b", "where is order number 5"), ("c", None)], "id string, t string")
    kept, out = rules.without_artifacts(df, "id", F.col("t"))
    assert got(kept.select("id")) == [("b",), ("c",)] and got(out) == [("a",)]


def test_configuration_checks(spark):
    df = spark.createDataFrame([("a", " todo: x"), ("b", "fine"), ("c", None), ("d", " "), ("e", "https://x.org/a"), ("f", "https:///a"), ("g", "ftp://x")], "id string, t string")
    assert [r.id for r in df.where(rules.is_unfinished(F.col("t"))).collect()] == ["a", "c", "d"]
    assert [r.id for r in df.where(rules.is_http_url(F.col("t"))).collect()] == ["e"]
    text = spark.createDataFrame([("r", "one\n TODO two\nTODOS\n[PENDING x]")], "id string, t string")
    assert got(rules.todo_lines(text, "id", "t")) == [("r", 2, "TODO two"), ("r", 4, "[PENDING x]")]
    h = "path string, sha256 string, bytes long, hub_url string, base_revision string, converter_commit string, tokenizer_sha string, prompt_sha string, ollama_version string, created_at string"
    good = ("a/b", "a" * 64, 1, None, "b" * 40, "c" * 40, "d" * 64, "e" * 64, "1", "2026-01-02 03:04 IST")
    bad = ("../b", "A" * 64, 0, "x", "b" * 39, None, "d", "", "", "2026-01-02")
    assert got(validate.row_violations(spark.createDataFrame([good], h), "path", rules.artifact_rules())) == []
    assert {r.rule_id for r in validate.row_violations(spark.createDataFrame([bad], h), "path", rules.artifact_rules()).collect()} == set(rules.artifact_rules())


def test_provenance(spark):
    df = spark.createDataFrame([("a", "old", "new")], "id string, response string, target string")
    r = rules.with_provenance(df, F.col("target"), "F", "S").first()
    assert (r.original_response, r.response, r.flags, r.target_source) == ("old", "new", "F", "S")


def test_labels_attach(spark):
    pairs = spark.createDataFrame([("p1", "stale"), ("p2", "stale")], "id string, reason string")
    both, left = joins.attach_labels(pairs, spark.createDataFrame([("p1", "same", True)], "id string, reason string, same boolean"), "id")
    assert got(both.select("id", "reason", "same")) == [("p1", "same", True), ("p2", None, None)] and got(left) == [("p2",)]


def test_phrase_hits(spark):
    df = spark.createDataFrame([("I can\u2019t do it, rest assured",), ("I don't know and I can't",), ("fine",), (None,)], "t string")
    df = rules.phrase_scan(df, F.col("t"))
    hits = profile.phrase_hits(df, {"admit": F.col("admit"), "rest_assured": F.col("rest_assured"), "declines": F.col("declines")}, F.filter(F.split("admit_phrases", r"\|"), lambda p: p != ""))
    assert got(hits) == sorted([("rows", "", 4), ("flag", "admit", 2), ("flag", "rest_assured", 1), ("flag", "declines", 0), ("phrase", "i can't", 2), ("phrase", "i don't know", 1)], key=repr)


def test_score_summary(spark):
    df = spark.createDataFrame([("i", "g1", 1.0, True), ("i", "g1", 3.0, None), ("j", "g2", 8.0, False)], "intent string, g string, v double, e boolean")
    assert got(profile.score_summary(df, "intent", "g", ["v"], ["e"])) == sorted([(True, None, 3, 2, 4.0, 3.0, 1 / 3), (False, "i", 2, 1, 2.0, 2.0, 0.5), (False, "j", 1, 1, 8.0, 8.0, 0.0)], key=repr)
    assert got(profile.score_summary(df.where("false"), "intent", "g", ["v"], ["e"])) == [(True, None, 0, 0, 0.0, 0.0, 0.0)]


def test_quota_is_backfilled_richest_first(spark):
    sizes = {"a": 1, "b": 5, "c": 4, "d": 2}
    df = spark.createDataFrame([(s, f"{s}{g}", f"{s}{g}-{k}") for s, n in sizes.items() for g in range(n) for k in range(2)], "s string, g string, id string")
    rows = selection.quota_backfilled(df, "s", "g", "id", 2, 10, "x").collect()
    assert len(rows) == len({r.g for r in rows}) == 10
    assert {s: sum(r.s == s for r in rows) for s in sizes} == {"a": 1, "b": 4, "c": 3, "d": 2}
    assert sorted(r.s for r in rows if r.backfilled) == ["b", "b", "c"]
    with pytest.raises(ValueError):
        selection.quota_backfilled(df, "s", "g", "id", 2, 13, "x")


def test_banded_pairs(spark):
    data = [("i", "low", f"r{k:03d}", f"s{k:03d}", f"t{k}", "u") for k in range(200)] + [("j", "low", "r900", "s900", "u", "t900"), ("j", "low", "r901", "s901", "t900", "u"), ("j", "high", "r902", "s902", "x", "y")]
    df = spark.createDataFrame(data, "intent string, band string, row_a string, row_b string, a string, b string")
    rows = selection.banded_pairs(df, "intent", "band", F.col("a"), F.col("b"), {"low": 5, "high": 3}, "x").collect()
    assert sorted((r.band, r.intent) for r in rows) == [("high", "j")] + [("low", "i")] * 4 + [("low", "j")]
    all_low = selection.banded_pairs(df, "intent", "band", F.col("a"), F.col("b"), {"low": 500}, "x").collect()
    assert sum(r.intent == "i" for r in all_low) == 80 and sum(r.intent == "j" for r in all_low) == 1


def test_complete_linkage_and_unions(spark):
    at = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    df = spark.createDataFrame([(1, at(0), "s", "x"), (2, at(30), "s", "y"), (3, at(55), "s", "z"), (4, at(180), "s", "x"), (5, None, "s", "z")], "id int, v array<double>, s string, t string")
    vectors = df.where("v is not null")
    cut = float(np.cos(np.radians(45)))
    assert {r.id: r.cluster for r in grouping.average_linkage(vectors, "id", "v", "s", cut, complete=True).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    assert {r.id: r.root for r in grouping.linkage_groups(df, "id", "v", "s", [F.col("t")], cut, complete=True).collect()} == {1: 1, 4: 1, 2: 2, 3: 2, 5: 2}
