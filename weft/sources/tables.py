"""Tables of earlier runs: text with a header line, or Parquet, with their columns checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import schema
from weft.sources.paf import read_lines, with_place

c = F.col


class NotATable(ValueError):
    """The file isn't the table that is asked for."""


def require(columns: list[str], wanted: list[str], what: str) -> None:
    missing = [w for w in wanted if w not in columns]
    if missing:
        raise NotATable(f"{what} lacks the column{'s' * (len(missing) > 1)} {', '.join(missing)}")


def read_tsv(spark: SparkSession, path: str, what: str = "the table", in_order: bool = False) -> DataFrame:
    """All columns as text, by the header's names. Fields are split at tabs alone; blank lines are skipped; absent cells are empty."""
    lines = with_place(spark, path) if in_order else read_lines(spark, path)
    # the header is the first line of the file: a one-row job
    first = read_lines(spark, path).limit(1).collect()
    if not first or not first[0]["value"]:
        raise NotATable(f"{what} at {path} is empty")
    head = first[0]["value"]
    names = head.split("\t")
    body = lines.filter((c("value") != F.lit(head)) & (F.trim("value") != "")).withColumn("__f", F.split("value", "\t"))
    return body.select(*[F.coalesce(F.get("__f", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)], *(["place"] if in_order else []))


def typed(rows: DataFrame, columns) -> DataFrame:
    """Text columns as their kinds: numbers that can't be read are null, NaN is null, text stays."""
    kinds = dict(columns)

    def cell(name: str):
        kind = kinds.get(name, "s")
        if kind == "s":
            return c(name)
        value = F.nullif(c(name), F.lit("")).try_cast(schema.SQL_TYPES[kind])
        return F.when(~F.isnan(value), value) if kind == "f" else value

    return rows.select(*[cell(n).alias(n) for n in rows.columns])


def read_readinfo(spark: SparkSession, path: str, side: str) -> DataFrame:
    """A 37-column table, with ``place``; from text or Parquet."""
    names = schema.names(schema.READINFO)
    if path.endswith(".parquet"):
        rows = spark.read.parquet(path)
        require(rows.columns, names, f"the readinfo table of side {side}")
        return rows.select(*names, F.struct(F.lit(0).cast("bigint").alias("__at"), F.monotonically_increasing_id().alias("__id")).alias("place"))
    rows = read_tsv(spark, path, f"the readinfo table of side {side}", in_order=True)
    require(rows.columns, names, f"the readinfo table of side {side}")
    return typed(rows.select(*names, "place"), schema.READINFO)


def read_alninfo(spark: SparkSession, path: str) -> DataFrame:
    """A 36-column table of text, with ``place``."""
    rows = read_tsv(spark, path, "the alninfo table", in_order=True)
    names = schema.names(schema.ALNINFO)
    require(rows.columns, names, "the alninfo table")
    return typed(rows.select(*names, "place"), schema.ALNINFO)


def read_comparison(spark: SparkSession, path: str, form: str = "auto", columns: list[str] | None = None, parquet_only: bool = False) -> DataFrame:
    """A comparison table, pruned to ``columns``. ``auto``: Parquet by the path's end."""
    parquet = path.rstrip("/").endswith(".parquet") if form == "auto" else form == "parquet"
    if parquet_only and not parquet:
        raise NotATable(f"{path}: this command reads Parquet comparison tables only")
    if parquet and path == "-":
        raise NotATable("Parquet can't be read from standard input")
    rows = spark.read.parquet(path) if parquet else read_tsv(spark, path, "the comparison table")
    if not {"target_name_A", "target_name_B"} <= set(rows.columns):
        raise NotATable(f"{path} is no comparison table: target_name_A and target_name_B are missing")
    labels = [x for x in ("label_A", "label_B") if x in rows.columns]
    wanted = columns or schema.names(schema.COMPARISON)
    require(rows.columns, [w for w in wanted if w not in ("label_A", "label_B")], "the comparison table")
    rows = rows.select(*dict.fromkeys([*[w for w in wanted if w in rows.columns], *labels]))
    if not parquet:
        return rows
    # tables of other writers may have unsigned or narrow numbers
    kinds = dict(schema.COMPARISON)
    return rows.select(*[c(n).cast("bigint").alias(n) if kinds.get(n) in ("n", "i") else c(n) for n in rows.columns])


def labels_of(rows: DataFrame) -> tuple[str, str]:
    """Labels of the first row; A and B if there is none or they are blank."""
    have = [x for x in ("label_A", "label_B") if x in rows.columns]
    first = (rows.select(*have).limit(1).collect() if have else []) or [{}]
    row = first[0].asDict() if have and first[0] else {}
    return row.get("label_A") or "A", row.get("label_B") or "B"
