"""PAF text: lines to typed columns, with malformed lines set apart.

Lines end at ``\\n``; a carriage return before it is dropped. Blank lines and lines that begin with ``#``
are skipped. The first twelve fields are mandatory. Tags of unmapped lines are not read; of a tag
that repeats, the last counts; a score that is no number is 0. Plain and gzip files are read, those of
several gzip members too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import schema
from weft.functions.cs import apart

c = F.col
WHOLE = "^\\+?[0-9]+$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of each line, without its end."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.regexp_replace("value", "\\r+$", "").alias("value"))


def natural(text: Column, most: int = 2**63 - 1) -> Column:
    """A non-negative whole number of plain digits, or null."""
    value = text.try_cast("bigint")  # null beyond 63 bits
    return F.when(text.rlike(WHOLE) if most > 2**62 else text.rlike(WHOLE) & (value <= most), value)


def tag_values(tags: Column, name: str) -> Column:
    """The last value of a tag such as ``ms:i`` that isn't empty, or null."""
    ahead, all_tags = f"\t{name}:", F.concat(F.lit("\t"), tags)
    last = F.substring_index(F.substring_index(all_tags, ahead, -1), "\t", 1)
    # an empty value at the last place is rare: only then the tags are searched by a pattern
    earlier = F.regexp_extract(all_tags, f"(?s)^.*{ahead}([^\t]+)", 1)
    return F.when(F.contains(all_tags, F.lit(ahead)), F.when(last != "", last).otherwise(F.nullif(earlier, F.lit(""))))


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alignments, rejected lines with a reason) of a frame with ``value``; other columns are kept."""
    more = [x for x in lines.columns if x != "value"]
    real = lines.filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    # generated, not projected: a filter on the reason would be pushed below with the split in each of its terms
    parts = real.select("*", F.explode(F.array(F.split("value", "\t", 13))).alias("__f"))
    names = schema.names(schema.PAF_COLUMNS)
    numbers = [n for n, kind in schema.PAF_COLUMNS if kind == "n"]
    field = {n: F.get("__f", F.lit(i)) for i, n in enumerate(names)}
    whole = F.struct(*[natural(field[n], 2**32 - 1 if n == "mapq" else 2**63 - 1).alias(n) for n in numbers])
    read = parts.select("*", apart(F.size("__f")).alias("__size"), whole.alias("__whole")).select("*", F.explode(F.array("__whole")).alias("__n"))
    bad = (
        F.when(c("__size") < 12, "fewer than 12 fields")
        .when(F.greatest(*[c(f"__n.{n}").isNull() for n in numbers]), "a number of plain digits is missing or too large")
        .when(~field["strand"].isin("+", "-", "*"), "strand is none of + - *")
    )
    typed = read.select(
        *more, "value", bad.alias("reason"), F.coalesce(F.get("__f", F.lit(12)), F.lit("")).alias("__tags"), *[(c(f"__n.{n}") if n in numbers else field[n]).alias(n) for n in names],
    )
    mapped = apart((c("target_name") != "*") & (c("strand") != "*"))
    score = lambda name: F.when(mapped, F.coalesce(tag_values(c("__tags"), name).try_cast("bigint"), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    letter = lambda name: F.when(mapped, F.coalesce(F.left(tag_values(c("__tags"), name), F.lit(1)), F.lit("*"))).otherwise("*")
    good = typed.filter("reason is null").select(
        *more, *names, score("ms:i").alias("ms_score"), score("AS:i").alias("as_score"), F.when(mapped, F.coalesce(tag_values(c("__tags"), "cs:Z"), F.lit(""))).otherwise("").alias("cs"),
        letter("tp:A").alias("tp_tag"), letter("ts:A").alias("ts_tag"), letter("XS:A").alias("xs_tag"), c("value").alias("line"),
    )
    return good, typed.filter("reason is not null").select(*more, c("value").alias("line"), "reason")


def line_names(lines: DataFrame) -> DataFrame:
    """(query_name) of each line that is no comment, malformed ones too."""
    real = lines.filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    return real.select(F.get(F.split("value", "\t", 2), F.lit(0)).alias("query_name"))


def with_place(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``place``, their order in the file.

    A gzip file, or one read as one partition, is in order; ids increase with partitions, which
    follow the file. Spark may pack splits out of order only across files.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    numbered = lines.withColumn("__at", F.col("_metadata.file_block_start")).withColumn("__id", F.monotonically_increasing_id())
    return numbered.select(F.regexp_replace("value", "\\r+$", "").alias("value"), F.struct("__at", "__id").alias("place"))


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    return parse(read_lines(spark, path))[0]


def order_violations(rows: DataFrame, place: str = "place") -> DataFrame:
    """Names that follow a greater name (in bytes); a window over the file's order, so for checks of sorted input only."""
    from pyspark.sql import Window

    before = F.lag("query_name").over(Window.orderBy(place))
    return rows.select("query_name", place, before.alias("__before")).filter(c("__before") > c("query_name")).drop("__before")
