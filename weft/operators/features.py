"""Features of single alignments (the 36-column table)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft import schema
from weft.functions import cs as C
from weft.functions import text as X
from weft.functions.memo import remembered

c = F.col


def is_mapped_paf() -> Column:
    """By target and strand, as the scan of PAF lines sees it."""
    return (c("target_name") != "*") & (c("strand") != "*")


def transcript_strand(strand: Column, ts: Column, xs: Column) -> Column:
    """A known ts as it stands; else XS, relative to the alignment's strand; else ``*``."""
    return (
        F.when(~strand.isin("+", "-"), "*")
        .when(ts.isin("+", "-"), ts)
        .when(xs.isin("+", "-"), F.when(xs == strand, "+").otherwise("-"))
        .otherwise("*")
    )


def intron_strand(strand: Column, transcript: Column) -> Column:
    known = strand.isin("+", "-") & transcript.isin("+", "-")
    return F.when(known & (strand == "+"), transcript).when(known, F.translate(transcript, "+-", "-+")).otherwise("*")


def less(a: Column, b: Column) -> Column:
    """a - b, at least 0."""
    return F.greatest(a - b, F.lit(0).cast("bigint"))


def softclips(mapped: Column) -> tuple[Column, Column, Column]:
    """(start, end, events) in the alignment's orientation."""
    head, tail = c("query_start"), less(c("query_len"), c("query_end"))
    zero = F.lit(0).cast("bigint")
    start = F.when(~mapped, zero).when(c("strand") == "-", tail).otherwise(head)
    end = F.when(~mapped, zero).when(c("strand") == "-", head).otherwise(tail)
    return start, end, (start > 0).cast("bigint") + (end > 0).cast("bigint")


def query_places(introns: Column, strand: Column, query_len: Column, query_start: Column, query_end: Column) -> Column:
    """Introns' places on the read's forward strand, in order of the alignment."""
    offset = F.when(strand == "-", less(query_len, query_end)).otherwise(query_start)
    return F.transform(introns, lambda i: F.when(strand == "-", query_len - (offset + i["q"])).otherwise(offset + i["q"]))


def genomic_places(introns: Column, target_start: Column) -> Column:
    return F.transform(introns, lambda i: F.struct((target_start + i["start"]).alias("start"), (target_start + i["end"]).alias("end")))


def ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b, F.lit(0)).cast("double")


@remembered
def _derived() -> dict[str, Column]:
    """Columns over those of a PAF line, __events and __introns."""
    start, end, events = softclips(is_mapped_paf())
    return {
        "aln_identity": ratio(c("n_residue_matches"), c("aln_block_len")),
        "query_aln_len": less(c("query_end"), c("query_start")),
        "query_aln_cov": ratio(less(c("query_end"), c("query_start")), c("query_len")),
        "genomic_intron_strand": intron_strand(c("strand"), c("query_transcript_strand")),
        **{f"n_{e}_{w}": c(f"__events.n_{e}_{w}") for e in ("match", "substitution", "insertion", "deletion", "intron") for w in ("events", "bases")},
        "n_softclip_events": events,
        "n_softclip_bases_start": start,
        "n_softclip_bases_end": end,
        "query_junctions": X.int_tuple(F.array_sort(query_places(c("__introns"), c("strand"), c("query_len"), c("query_start"), c("query_end")))),
        "genomic_junctions": X.span_tuple(genomic_places(c("__introns"), c("target_start"))),
    }


def derive(paf: DataFrame) -> DataFrame:
    """``paf`` (PAF columns, ms_score, as_score, tp_tag, ts_tag, xs_tag, cs) with all derived columns beside its own."""
    mapped = is_mapped_paf()
    clean = paf.withColumns({"ts_tag": F.when(mapped, c("ts_tag")).otherwise("*"), "cs": F.when(mapped, F.coalesce("cs", F.lit(""))).otherwise("")})
    found = clean.withColumns({"__events": C.event_counts(c("cs")), "__introns": C.introns(c("cs")), "query_transcript_strand": F.when(mapped, transcript_strand(c("strand"), c("ts_tag"), c("xs_tag"))).otherwise("*")})
    return found.withColumns(_derived()).drop("__events", "__introns")


def alninfo(paf: DataFrame) -> DataFrame:
    """The 36 columns of each alignment; cs escaped as in its text form."""
    return derive(paf).withColumn("cs", X.escape(c("cs"))).select(*schema.names(schema.ALNINFO))
