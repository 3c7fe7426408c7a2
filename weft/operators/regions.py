"""Reads whose alignments differ, and the merged regions in which they lie.

Touching intervals merge. A contig's intervals are merged within bins of the coordinate first, so a
contig with a third of all reads is spread over many tasks; only the islands of bins meet in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.classify import class_flags, classify, classify_columns, decide, stacked

c = F.col
BIN = 1 << 20
COUNTS = ["n_diff_aln_total", "n_diff_aln_both", "n_diff_aln_only", "n_diff_aln_plus_strand", "n_diff_aln_minus_strand"]


def islands(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Merged [start, end) of ``rows`` by ``keys``, with sums."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    opened = rows.withColumn("__new", (F.coalesce(c("start") > F.max("end").over(before), F.lit(True))).cast("int"))
    named = opened.withColumn("__island", F.sum("__new").over(upto))
    return named.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.sum(s).alias(s) for s in sums]).drop("__island")


def merged(rows: DataFrame, sums: list[str]) -> DataFrame:
    """Islands by chrom, through bins."""
    binned = islands(rows.withColumn("__bin", F.floor(c("start") / BIN)), ["chrom", "__bin"], sums)
    return islands(binned.drop("__bin"), ["chrom"], sums)


def intervals(decided: DataFrame, side: str) -> DataFrame:
    """(chrom, start, end, counts) of differing reads mapped on ``side``; rows without a proper span are left out."""
    name = F.coalesce(f"target_name_{side}", F.lit(""))
    start, end = (c(f"target_{w}_{side}").try_cast("bigint") for w in ("start", "end"))
    both, strand = c("outcome") == "diff_aln_both", c(f"strand_{side}")
    one = lambda x: F.coalesce(x, F.lit(False)).cast("bigint")
    rows = decided.filter(c("outcome").isin("diff_aln_both", f"diff_aln_only_{side}")).select(
        name.alias("chrom"), start.alias("start"), end.alias("end"), F.lit(1).cast("bigint").alias(COUNTS[0]),
        one(both).alias(COUNTS[1]), one(~both).alias(COUNTS[2]), one(strand == "+").alias(COUNTS[3]), one(strand == "-").alias(COUNTS[4]),
    )
    return rows.filter((c("chrom") != "") & (c("chrom") != "*") & (c("end") > c("start")))


def n_bad_intervals(decided: DataFrame, side: str) -> int:
    return decided.filter(c("outcome").isin("diff_aln_both", f"diff_aln_only_{side}")).count() - intervals(decided, side).count()


def regions(decided: DataFrame, side: str) -> DataFrame:
    """The merged regions of a side; their only-count is named after the side."""
    found = merged(intervals(decided, side), COUNTS)
    return found.select("chrom", "start", "end", COUNTS[0], COUNTS[1], c(COUNTS[2]).alias(f"n_diff_aln_only_{side}"), COUNTS[3], COUNTS[4])


def decided(table: DataFrame, mode: str = "any-diff-query", both_only: bool = False) -> DataFrame:
    """Classified rows with outcome."""
    return classify(classify_columns(table)).withColumn("outcome", decide(mode, both_only))


def reads(rows: DataFrame, identical: bool = False) -> DataFrame:
    """(query_name, outcome, seven flags) of the reads that differ, or of those that don't."""
    wanted = F.startswith(c("outcome"), F.lit("diff_")) if not identical else ~F.startswith(c("outcome"), F.lit("diff_")) & (c("outcome") != "excluded")
    return rows.filter(wanted).select("query_name", "outcome", *[x.alias(k) for k, x in class_flags().items()])


OUTCOMES = ["identical_same_strand", "identical_revcomp", "neither_mapped", "diff_aln_both", "diff_aln_only_A", "diff_aln_only_B"]
SUMMARY_ROWS = [
    "reads_in_table", "reads_not_aligned_both_excluded", "reads_compared", "reads_identical", *OUTCOMES[:3], "reads_differ", *OUTCOMES[3:], "n_regions_A", "n_regions_B",
]


def summary(rows: DataFrame, regions_a: DataFrame, regions_b: DataFrame, mode: str = "any-diff-query", both_only: bool = False) -> DataFrame:
    """(category, count as text): mode and both_only first, then the counts."""
    n = lambda *names: F.count_if(c("outcome").isin(*names))
    counts = rows.agg(
        F.count("*").alias("reads_in_table"), n("excluded").alias("reads_not_aligned_both_excluded"), n(*OUTCOMES).alias("reads_compared"),
        n(*OUTCOMES[:3]).alias("reads_identical"), *[n(o).alias(o) for o in OUTCOMES], n(*OUTCOMES[3:]).alias("reads_differ"),
    )
    # three one-row tables side by side
    a, b = (r.agg(F.count("*").alias(f"n_regions_{s}")) for r, s in ((regions_a, "A"), (regions_b, "B")))
    one = lambda d: d.withColumn("__one", F.lit(1))
    whole = one(counts).join(one(a), "__one").join(one(b), "__one").withColumns({"mode": F.lit(mode), "aligned_both_only": F.lit(str(both_only).lower())})
    texts = whole.select("mode", *[c(r).cast("string").alias(r) for r in ["aligned_both_only", *SUMMARY_ROWS]])
    return stacked(texts, ["mode", "aligned_both_only", *SUMMARY_ROWS])
