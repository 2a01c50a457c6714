"""Writers and content hashes (SNK1 to SNK13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import safe_cell


def json_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """SNK1, SNK2: (value) with fixed column order, sorted where none is given."""
    return df.select(F.to_json(F.struct(*(columns or sorted(df.columns)))).alias("value"))


def row_hashes(df: DataFrame) -> DataFrame:
    """SNK5: (value, hash) of each row as canonical JSON."""
    return json_lines(df).withColumn("hash", F.sha2("value", 256))


def content_hash(df: DataFrame) -> str:
    """SNK4: a digest of a table that depends on no order of rows: the 256-bit row hashes are summed in four 64-bit limbs
    by an aggregate that combines before the shuffle, so no list of rows is built."""
    h = row_hashes(df)
    limb = lambda i: F.conv(F.substring("hash", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")
    sums = h.agg(F.count("*").alias("n"), *[F.sum(limb(i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)])
    return sums.select(F.sha2(F.concat_ws(":", "n", *[F.coalesce(f"s{i}", F.lit(0)).cast("string") for i in range(4)]), 256)).first()[0]


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """SNK6, SNK10: never overwrites; Spark's commit keeps a failed write invisible."""
    df.write.mode("errorifexists").format(kind).save(path)


def append_rows(df: DataFrame, path: str) -> None:
    """SNK3."""
    df.write.mode("append").json(path)


def sheet(df: DataFrame) -> DataFrame:
    """SNK7: every column a string that no spreadsheet runs as a formula."""
    return df.select(*[safe_cell(F.col(c).cast("string")).alias(c) for c in df.columns])


def write_sheet(df: DataFrame, path: str) -> None:
    sheet(df).write.mode("errorifexists").csv(path, header=True, escape='"', quoteAll=False)


def flat_grades(df: DataFrame) -> DataFrame:
    """SNK13: valid attempts only, grade fields as columns, booleans as lower-case text."""
    fields = [f.name for f in df.schema["grade"].dataType.fields]
    return df.where("status = 'valid'").select("item_id", *[F.lower(F.col(f"grade.{f}").cast("string")).alias(f) for f in fields])


def manifest(tables: dict[str, DataFrame]) -> list[dict]:
    """One record per table: rows and content hash."""
    return [{"table": k, "rows": df.count(), "hash": content_hash(df)} for k, df in sorted(tables.items())]


def html_rows(df: DataFrame) -> DataFrame:
    """SNK8: (value): each row as JSON that may stand inside a script element."""
    from corpusloom.functions.text import html_json

    return df.select(html_json(F.struct(*sorted(df.columns))).alias("value"))


def markdown_table(df: DataFrame, order: list[str], most: int = 1000) -> str:
    """SNK9: a small result as a table in Markdown, rows in order; bars and line ends inside cells are escaped. An error beyond
    ``most`` rows, as a report is read by people."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in rows]) + "\n"


def chunks(df: DataFrame, key: str, content: str, size: int) -> DataFrame:
    """SNK11: (key, part, name, chunk, sha, total_sha): contents cut into parts of at most ``size`` characters."""
    n = F.greatest(F.ceil(F.length(content) / size), F.lit(1)).cast("int")
    x = df.select(key, F.col(content).alias("_c"), F.sha2(content, 256).alias("total_sha"), F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    chunk = F.substring("_c", F.col("part") * size + 1, F.lit(size))
    return x.select(key, "part", F.format_string("part-%05d", F.col("part")).alias("name"), chunk.alias("chunk"), F.sha2(chunk, 256).alias("sha"), "total_sha")


def reassembled(parts: DataFrame, key: str) -> DataFrame:
    """SNK11: (key, content, intact): parts joined in the order of their names; intact if each part, the whole and the numbering
    agree with their digests."""
    g = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("name", "chunk"))).alias("p"), F.min(F.sha2("chunk", 256) == F.col("sha")).alias("ok"), F.max("total_sha").alias("total"), F.max("part").alias("last"), F.count("*").alias("n"))
    whole = F.array_join(F.transform("p", lambda x: x["chunk"]), "")
    return g.select(key, whole.alias("content"), (F.col("ok") & (F.sha2(whole, 256) == F.col("total")) & (F.col("n") == F.col("last") + 1)).alias("intact"))
