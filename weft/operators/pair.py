"""Reads of two sets, paired by name; names in one set only are counted.

Equal names are paired one to one in order, so a name that a set holds twice makes no products.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class ReadSetMismatch(ValueError):
    """The two sets don't hold the same reads."""


@dataclass(frozen=True)
class IdCheck:
    n_a: int
    n_b: int
    n_shared: int
    examples_a: tuple[str, ...]
    examples_b: tuple[str, ...]

    @property
    def n_only_a(self) -> int:
        return self.n_a - self.n_shared

    @property
    def n_only_b(self) -> int:
        return self.n_b - self.n_shared


def names_of_both(a: DataFrame, b: DataFrame, read: str = "query_name") -> DataFrame:
    """(query_name, in_a, in_b), one row a distinct name; or by another column that tells reads apart."""
    flags = a.select(read, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).union(b.select(read, F.lit(0), F.lit(1)))
    return flags.groupBy(read).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


def id_counts(a: DataFrame, b: DataFrame, read: str = "query_name") -> DataFrame:
    """One row: n_a, n_b, n_shared, n_only_a, n_only_b distinct names."""
    both = names_of_both(a, b, read)
    return both.agg(
        F.sum("in_a").alias("n_a"), F.sum("in_b").alias("n_b"), F.count_if(F.expr("in_a + in_b = 2")).alias("n_shared"),
        F.count_if(F.col("in_b") == 0).alias("n_only_a"), F.count_if(F.col("in_a") == 0).alias("n_only_b"),
    )


def check_ids(a: DataFrame, b: DataFrame) -> IdCheck:
    """Counts, and the first five names of each set that the other lacks."""
    row = id_counts(a, b).first()
    both = names_of_both(a, b)
    first = lambda flag: tuple(r[0] for r in both.filter(f"{flag} = 0").select("query_name").orderBy("query_name").limit(5).collect())
    n_a, n_b, shared = row["n_a"] or 0, row["n_b"] or 0, row["n_shared"]
    return IdCheck(n_a, n_b, shared, first("in_b") if n_a > shared else (), first("in_a") if n_b > shared else ())


def require_same_ids(a: DataFrame, b: DataFrame, label_a: str = "A", label_b: str = "B") -> IdCheck:
    found = check_ids(a, b)
    if found.n_only_a or found.n_only_b:
        raise ReadSetMismatch(
            f"read sets differ: {found.n_shared} shared, {found.n_only_a} only in {label_a} (e.g. {', '.join(found.examples_a)}), "
            f"{found.n_only_b} only in {label_b} (e.g. {', '.join(found.examples_b)}); allow_id_mismatch=True keeps the shared ones"
        )
    return found


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``__nth``, a name's occurrence in order of the column ``order``."""
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy("query_name").orderBy(order)))


def paired(a: DataFrame, b: DataFrame, order: str | None = None, how: str = "inner", read: str | None = None) -> DataFrame:
    """Columns of ``a`` and ``b`` suffixed ``_A`` and ``_B``, joined on query_name (and occurrence, given an order column).

    ``read`` is a column that tells reads apart as query_name does, by which both are partitioned; it is joined on instead.
    """
    if read:
        own = [x.select(read, *([F.col("query_name")] if s == "A" else []), *[F.col(c).alias(f"{c}_{s}") for c in x.columns if c not in ("query_name", read)]) for x, s in ((a, "A"), (b, "B"))]
        return own[0].join(own[1], read).drop(read)
    if order:
        a, b = (numbered(x, order).drop(order) for x in (a, b))
    sides = [x.select("query_name", *(["__nth"] if order else []), *[F.col(c).alias(f"{c}_{s}") for c in x.columns if c not in ("query_name", "__nth")]) for x, s in ((a, "A"), (b, "B"))]
    return sides[0].join(sides[1], ["query_name", *(["__nth"] if order else [])], how).drop("__nth")
