"""What the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session (tests) may go without the setting; it gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(context, "_weft_shared", None)
    if own is None:
        own = context._weft_shared = "file://" + tempfile.mkdtemp(prefix="weft-")
    return own


def cut(frame: DataFrame) -> DataFrame:
    """``frame``, computed and kept in the shared folder: its lineage ends there.

    The context cleaner removes the files once no plan refers to them (with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    context = frame.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(frame.sparkSession))
    return frame.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/weft/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once however often ``body`` uses it.

    Catalyst may inline a projected column into a lambda, where it would be computed
    for every element; a lambda's own argument is computed once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def null_safe(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


BLOCK = 256


def running_starts(lengths: Column) -> Column:
    """The sum of all earlier elements, for each element of an array.

    Sums of blocks are built first, so an array of n elements takes n * (n / 256 + 256)
    steps and not n * n.
    """
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc + x)
    n_blocks = F.ceil(F.size(lengths) / BLOCK).cast("int")
    sums = F.transform(F.sequence(F.lit(0), n_blocks), lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))

    def within(blocks: Column) -> Column:
        before = F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))
        return let(
            before,
            lambda pre: F.transform(
                lengths,
                lambda _, i: F.element_at(pre, F.floor(i / BLOCK).cast("int") + 1)
                + total(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, (i % BLOCK).cast("int"))),
            ),
        )

    return let(sums, within)


def spans_of(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as array<struct<start,end,hit,before>>.

    ``start`` and ``end`` count code points. ``before`` holds up to 40 characters before the
    match. ``pattern`` must not look ahead, and ``\\G`` in it means the end of the match before.
    ``gate`` is a cheap test that holds for every text with a match.

    Each piece is the gap since the last match and the match, so the lengths of the pieces
    give the places. ``\\G`` keeps a text's tail without matches from being searched again
    from every place in it.
    """
    none = F.lit(None).cast("array<struct<start:bigint,end:bigint,hit:string,before:string>>")
    pieces = F.regexp_extract_all(text, F.lit(f"\\G(?s).*?(?:{pattern})"), F.lit(0))

    def located(pieces: Column) -> Column:
        def with_hits(hits: Column) -> Column:
            lengths = F.transform(pieces, lambda p: F.char_length(p).cast("long"))
            return let(
                lengths,
                lambda ls: let(
                    running_starts(ls),
                    lambda starts: F.transform(
                        starts,
                        lambda s, i: F.struct(
                            (s + F.get(ls, i) - F.char_length(F.get(hits, i))).alias("start"),
                            (s + F.get(ls, i)).alias("end"),
                            F.get(hits, i).alias("hit"),
                            F.right(F.substring(F.get(pieces, i), F.lit(1), (F.get(ls, i) - F.char_length(F.get(hits, i))).cast("int")), F.lit(40)).alias("before"),
                        ),
                    ),
                ),
            )

        hits = F.transform(pieces, lambda p: F.regexp_extract(p, f"(?s){pattern}", 0))
        return F.when(F.size(pieces) == 0, none).otherwise(let(hits, with_hits))

    found = let(pieces, located)
    if gate is not None:
        found = F.when(gate, found)
    return F.coalesce(found, F.array().cast(none_type()))


def sql_spans(pattern: str) -> str:
    """DuckDB: a list of {s, e, h, b} of a pattern's matches in t; the pattern has no groups of its own."""
    both = f"'(?s)(.*?)({pattern})'"
    return (
        f"(SELECT list_transform(range(1, len(h) + 1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0), "
        f"'e': list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(h[1:i], lambda x: length(x))), 'h': h[i], 'b': right(g[i], 40)}}) "
        f"FROM (SELECT regexp_extract_all(t, {both}, 1) AS g, regexp_extract_all(t, {both}, 2) AS h))"
    )


def none_type() -> str:
    return "array<struct<start:bigint,end:bigint,hit:string,before:string>>"


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, whose rows are few a key; one key may hold a third of ``left``.

    Each left row takes one of ``salts`` places by its ``spread`` column, and each right row is
    copied to all of them, so a hot key's rows are spread over ``salts`` tasks.
    """
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


BROADCAST_ROWS = 200_000


def bounded(frame: DataFrame) -> DataFrame:
    """``frame``, narrow and already cut, sent to all tasks if it has at most BROADCAST_ROWS rows; else joined by shuffles."""
    return F.broadcast(frame) if frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else frame


def without_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``rows`` whose id isn't among ``ids`` (one column, distinct); null equals null."""
    ids = ids.toDF("__without")
    return rows.join(bounded(ids), F.col(id_col).eqNullSafe(F.col("__without")), "left_anti")
