"""Readers with the reference's strictness (SRC1 to SRC21)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_strings(spark: SparkSession, path: str, required: list[str] = ()) -> DataFrame:
    """SRC1 to SRC3, SRC12: every column a string, empty stays empty, nothing is read as null; an error names missing columns."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="\x00", emptyValue="", inferSchema=False)
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    return df.na.fill("")  # an unquoted empty field is empty too


def with_row_ids(df: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """SRC1: id = prefix and the six-digit position in a total order of the rows, from 0. The position of a line in a file is no
    property of a distributed table, so the order is a parameter; numbers are given by ranges, not in one task."""
    from corpusloom.operators.profile import batches

    x = batches(df, F.struct(*order), 1)
    return x.withColumn("id", F.format_string(prefix + "%06d", F.col("position"))).drop("position", "batch")


def nonempty(df: DataFrame, column: str) -> DataFrame:
    """SRC3, SRC7: df with the column trimmed; an error where the table or any value is empty."""
    x = df.withColumn(column, F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"^\s+|\s+$", ""))
    n, bad = x.agg(F.count("*"), F.count_if(F.col(column) == "")).first()
    if not n or bad:
        raise ValueError("no rows" if not n else f"{bad} rows without {column}")
    return x


def present(spark: SparkSession, paths: list[str]) -> list[str]:
    """SRC7, SRC15: the paths that lack a file or hold nothing; the file system of each path is asked, no data are read."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.exists(path) or fs.getContentSummary(path).getLength() == 0:
            out.append(p)
    return out


def id_violations(df: DataFrame, key: str = "id") -> DataFrame:
    """SRC6, SRC9, SRC12: (rule_id, row_key, detail): blank and repeated ids."""
    blank = df.where(F.col(key).isNull() | (F.trim(F.col(key)) == "")).select(F.lit("blank_id").alias("rule_id"), F.lit("").alias("row_key"), F.lit("").alias("detail"))
    n = df.where(F.trim(F.col(key)) != "").groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return blank.unionByName(n.select(F.lit("repeated_id").alias("rule_id"), F.col(key).cast("string").alias("row_key"), F.col("n").cast("string").alias("detail")))


def comparison_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC9: (rows (id, instruction, group_id), violations). The instruction column is used where the table has one, else the query;
    a missing group column gives the id. A null where the column is there is a violation, not a fall-back."""
    text = F.col("instruction" if "instruction" in df.columns else "query")
    group = F.col("group_id") if "group_id" in df.columns else F.col("id")
    x = df.select("id", text.alias("instruction"), group.alias("group_id"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    bad = F.filter(F.array(F.when(blank("instruction"), "missing_query"), F.when(blank("group_id"), "invalid_group")), lambda r: r.isNotNull())
    return x, id_violations(x).unionByName(x.select(F.explode(bad).alias("rule_id"), F.coalesce("id", F.lit("")).alias("row_key"), F.lit("").alias("detail")))


def source_counts(named: DataFrame, expected: list[str]) -> DataFrame:
    """SRC15: (origin, n) of union_named() for every expected source, 0 where it has no rows."""
    want = named.sparkSession.createDataFrame([(s,) for s in expected], "origin string")
    return want.join(named.groupBy("origin").agg(F.count("*").alias("n")), "origin", "left").na.fill(0, ["n"])


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC4: one object per line; blank lines are skipped. A declared schema, so no pass to infer one."""
    return spark.read.schema(schema).json(path)


def jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """SRC5, SRC6: (rows, bad lines (path, value)). Bad lines are not JSON objects of the schema; they are returned with their
    file, not dropped. A line's number is no property of a split file; the line itself is."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")).where("trim(value) <> ''")
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    x = lines.select("value", "path", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.col("value").rlike(r"^\s*\{")
    return x.where(~bad).select(*[f"r.{f.name}" for f in schema.fields]), x.where(bad).select("path", "value")


def unique_object(text: str) -> dict:
    """SRC8: a JSON object without repeated keys, for small configuration files on the driver."""

    def pairs(items):
        out = {}
        for k, v in items:
            if k in out:
                raise ValueError(f"repeated key {k!r}")
            out[k] = v
        return out

    got = json.loads(text, object_pairs_hook=pairs)
    if not isinstance(got, dict):
        raise ValueError("not an object")
    return got


def query_text(df: DataFrame) -> DataFrame:
    """SRC9, SRC10: df with text: the instruction where the table has that column, else the query; a null there stays null."""
    return df.withColumn("text", F.trim(F.col("instruction" if "instruction" in df.columns else "query")))


def answer_text(df: DataFrame) -> DataFrame:
    """SRC11: the answer, or the response where it is null."""
    have = [F.col(c) for c in ("answer", "response") if c in df.columns]
    return df.withColumn("text", F.coalesce(*have) if have else F.lit(None).cast("string"))


def target_maps(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """SRC13: (id, target) of JSON maps with any keys, and (id, problem) for repeated ids, blanks and control marks."""
    from corpusloom.operators.rules import has_control_marks

    text = spark.read.text(paths, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    rows = text.select(F.explode("m").alias("id", "target"))
    blank = F.col("target").isNull() | (F.trim("target") == "")
    problem = F.when(blank, "blank").when(has_control_marks(F.col("target")), "control_mark")
    bad = rows.select("id", problem.alias("problem")).where("problem is not null")
    return rows, bad.unionByName(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated").alias("problem")))


def union_named(named: dict[str, DataFrame]) -> DataFrame:
    """SRC15: one table of several with the name of each as origin."""
    out = None
    for name, df in named.items():
        x = df.withColumn("origin", F.lit(name))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def markdown_section(df: DataFrame, text: str, mark: str) -> DataFrame:
    """SRC20: df with section: the lines from the first level-two heading that holds the mark to the next heading."""
    parts = F.filter(F.split(text, r"(?m)(?=^## )"), lambda p: p.startswith("## ") & F.substring_index(p, "\n", 1).contains(mark))
    return df.withColumn("section", F.get(parts, F.lit(0)))


def series(df: DataFrame) -> DataFrame:
    """SRC21: (step, kind, value) of a loss table; blank validation losses are skipped."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("v")) for k, c in (("train", "train_loss"), ("val", "val_loss"))])
    x = df.select(F.col("step").cast("int").alias("step"), F.explode(kinds).alias("k"))
    return x.where("trim(k.v) <> ''").select("step", "k.kind", F.col("k.v").cast("double").alias("value"))


def vector_problems(df: DataFrame, key: str, vector: str, tolerance: float = 1e-3) -> DataFrame:
    """SRC17: (key, problem) of cached vectors: missing, another size than the first, not finite, not of unit length."""
    v = F.col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = df.where(v.isNotNull()).select(F.size(vector)).limit(1).collect()
    n = size[0][0] if size else 0
    problem = F.when(v.isNull(), "missing").when(F.size(v) != n, "size").when(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite").when(F.abs(norm - 1) > tolerance, "not_unit")
    return df.select(key, problem.alias("problem")).where("problem is not null")
