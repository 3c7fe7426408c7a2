"""How the two alignments of a read agree: in query space, in reference space, in their junctions.

Works on typed tables and on tables read as text alike. Null and empty text are equal, as in text tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft import schema
from weft.functions import cs as C
from weft.functions import text as X
from weft.functions.memo import remembered
from weft.operators.compare import set_counts

c = F.col
MODES = ("any-diff-query", "any-diff-reference")


@remembered
def mapped(side: str) -> Column:
    name = F.coalesce(f"target_name_{side}", F.lit(""))
    return (name != "") & (name != "*")


def _same(name: str) -> Column:
    text = lambda s: F.coalesce(c(f"{name}_{s}").cast("string"), F.lit(""))
    return text("A") == text("B")


def classify(table: DataFrame) -> DataFrame:
    """``table`` with map_status, query_identical, query_identical_rc, ref_class and junctions_identical (the last two null unless both are mapped)."""
    both = mapped("A") & mapped("B")
    cs = lambda s: F.coalesce(f"cs_{s}", F.lit(""))
    # motifs are blanked, and the reverse complement made, only where they are needed
    blank = table.withColumns(
        {
            "map_status": F.when(both, "both").when(mapped("A"), "only_A").when(mapped("B"), "only_B").otherwise("neither"),
            "__cs_a": F.when(both, C.strip_motifs(cs("A"))),
            "__cs_b": F.when(both, C.strip_motifs(cs("B"))),
        }
    )
    span = _same("query_start") & _same("query_end")
    turned = F.when(both & span & ~_same("strand"), c("__cs_a") == C.strip_motifs(C.revcomp(cs("B"))))
    same_aln = c("__cs_a") == c("__cs_b")
    same_place = _same("target_name") & _same("strand") & _same("target_start")
    _, only_a, only_b = set_counts(X.parse_int_tuple(c("query_junctions_A")), X.parse_int_tuple(c("query_junctions_B")))
    made = blank.withColumns(
        {
            "query_identical_rc": F.coalesce(turned, F.lit(False)),
            "__same_strand": F.coalesce(both & span & _same("strand") & same_aln, F.lit(False)),
            "ref_class": F.when(both, F.concat(F.when(same_place, "same_position_").otherwise("diff_position_"), F.when(same_aln, "same_aln").otherwise("diff_aln"))),
            "junctions_identical": F.when(both, (only_a == 0) & (only_b == 0)),
        }
    )
    identical = c("__same_strand") | c("query_identical_rc") | (c("map_status") == "neither")
    return made.withColumn("query_identical", identical).drop("__cs_a", "__cs_b", "__same_strand")


@remembered
def class_flags() -> dict[str, Column]:
    """The seven 0/1 columns of classified rows."""
    both = c("map_status") == "both"
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    return {
        "query_identical_same_strand": flag(both & c("query_identical") & ~c("query_identical_rc")),
        "query_identical_revcomp": flag(both & c("query_identical_rc")),
        "query_junctions_identical": flag(c("junctions_identical")),
        **{f"ref_{k}": flag(c("ref_class") == k) for k in ("same_position_same_aln", "same_position_diff_aln", "diff_position_same_aln", "diff_position_diff_aln")},
    }


def stacked(counts: DataFrame, names: list[str]) -> DataFrame:
    """(category, count) of a one-row table, in order."""
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return counts.selectExpr(f"stack({len(names)}, {pairs}) as (category, count)")


SUMMARY_ROWS = [
    "reads_compared", "aligned_both", "aligned_only_A", "aligned_only_B", "aligned_neither", "query_identical", "query_identical_same_strand",
    "query_identical_revcomp", "query_not_identical", "query_junctions_identical", "query_junctions_not_identical", "ref_same_position_same_aln",
    "ref_same_position_diff_aln", "ref_diff_position_same_aln", "ref_diff_position_diff_aln", "present_only_in_A_by_id", "present_only_in_B_by_id",
]


def summary(classified: DataFrame, only_a: int | Column = 0, only_b: int | Column = 0) -> DataFrame:
    """The 17 counts, by one aggregation."""
    n = lambda x: F.count_if(x)
    status = c("map_status")
    flags = class_flags()
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("bigint")
    counts = classified.agg(
        F.count("*").alias("reads_compared"),
        *[n(status == s).alias(f"aligned_{s}") for s in ("both", "only_A", "only_B", "neither")],
        n(c("query_identical")).alias("query_identical"),
        *[n(x == 1).alias(k) for k, x in flags.items()],
        n((status == "both") & ~c("query_identical")).alias("query_not_identical"),
        n(c("junctions_identical") == F.lit(False)).alias("query_junctions_not_identical"),
    ).withColumns({"present_only_in_A_by_id": as_column(only_a), "present_only_in_B_by_id": as_column(only_b)})
    return stacked(counts, SUMMARY_ROWS)


@remembered
def decide(mode: str = "any-diff-query", both_only: bool = False) -> Column:
    """``excluded``, or the outcome of a classified row; outcomes ``diff_…`` differ, others are identical."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    identical = c("query_identical")
    if mode == "any-diff-reference":
        identical = identical & ~c("query_identical_rc") & F.startswith(c("ref_class"), F.lit("same_position"))
    status = c("map_status")
    decided = F.when((status != "both") & F.lit(both_only), "excluded").when(status == "only_A", "diff_aln_only_A").when(status == "only_B", "diff_aln_only_B")
    decided = decided.when(status == "neither", "neither_mapped").when(~F.coalesce(identical, F.lit(False)), "diff_aln_both")
    return decided.when(c("query_identical_rc"), "identical_revcomp").otherwise("identical_same_strand")


def classify_columns(table: DataFrame) -> DataFrame:
    """The columns that classification needs, and what follow-ups add."""
    return table.select("query_name", *[f"{n}_{s}" for n in schema.CLASSIFY_SIDE for s in "AB"])
