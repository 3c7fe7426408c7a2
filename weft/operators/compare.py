"""The 93-column comparison of two sets of representative alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft import schema
from weft.functions import text as X
from weft.functions.memo import remembered
from weft.operators.pair import paired

c = F.col


def _number(name: str, side: str) -> Column:
    """For differences, a missing integer is 0."""
    return F.coalesce(c(f"{name}_{side}"), F.lit(0).cast("bigint"))


def _gap(name: str) -> Column:
    return _number(name, "B") - _number(name, "A")


def _quotient(name: str) -> Column:
    return _number(name, "B").cast("double") / F.nullif(_number(name, "A"), F.lit(0)).cast("double")


def set_counts(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(shared, only in a, only in b) of two arrays as sets."""
    size = lambda x: F.size(x).cast("bigint")
    return size(F.array_intersect(a, b)), size(F.array_except(a, b)), size(F.array_except(b, a))


@remembered
def differences() -> dict[str, Column]:
    """The 19 columns, each B against A."""
    a, b = X.parse_int_tuple(c("query_junctions_A")), X.parse_int_tuple(c("query_junctions_B"))
    shared, only_a, only_b = set_counts(a, b)
    made = {
        "strand_match": F.coalesce("strand_A", F.lit("")) == F.coalesce("strand_B", F.lit("")),
        "aln_identity_diff": F.nanvl(c("aln_identity_B") - c("aln_identity_A"), F.lit(None)),
        "query_aln_cov_diff": F.nanvl(c("query_aln_cov_B") - c("query_aln_cov_A"), F.lit(None)),
        **{f"{n}_diff": _gap(n) for n in ("query_aln_len", "as_score", "ms_score")},
        **{f"{n}_ratio": _quotient(n) for n in ("as_score", "ms_score")},
        **{f"n_{n}_diff": _gap(f"n_{n}") for n in ("substitution_bases", "insertion_bases", "deletion_bases", "softclip_bases_start", "softclip_bases_end")},
        "n_query_junctions_shared": shared,
        "n_query_junctions_not_shared": only_a + only_b,
        "n_query_junctions_only_A": only_a,
        "n_query_junctions_only_B": only_b,
        "query_junctions_only_A": X.int_tuple(F.array_sort(F.array_except(a, b))),
        "query_junctions_only_B": X.int_tuple(F.array_sort(F.array_except(b, a))),
    }
    assert list(made) == schema.names(schema.DIFF)
    return made


def compare(a: DataFrame, b: DataFrame, label_a: str = "SetA", label_b: str = "SetB", order: str | None = None, read: str | None = None) -> DataFrame:
    """The comparison of two 37-column tables: reads of both sets, query_len from A, empty text as null. ``read`` as in ``paired``."""
    texts = {n for n, kind in schema.SIDE if kind == "s"}
    both = paired(a, b, order, read=read).withColumns({"query_len": c("query_len_A"), "label_A": F.lit(label_a), "label_B": F.lit(label_b)})
    blank = {f"{n}_{s}": F.nullif(c(f"{n}_{s}"), F.lit("")) for n in texts for s in "AB"}
    return both.withColumns(blank).withColumns(differences()).select(*schema.names(schema.COMPARISON))
