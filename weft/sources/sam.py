"""SAM text to PAF columns: filters, sanity, cs strings from tags or rebuilt, calibrated mismatches.

A record that can't be used is set apart with a reason; a mapped record that is kept but has no way to a
cs string is fatal, as a read without one would be summed up wrongly later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import cigar as G
from weft.sources.paf import natural, read_lines

c = F.col
RECORDS = ("all", "primary", "primary-supp")
FIELDS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
#: contigs that may be sent to all tasks; a longer list is joined by shuffles
BROADCAST_CONTIGS = 100_000


class NoDifferenceString(ValueError):
    """A mapped record has neither cs:Z nor MD:Z with SEQ."""


def _tag(tags: Column, name: str) -> Column:
    own = F.filter(F.split(tags, "\t"), lambda t: F.startswith(t, F.lit(name + ":")) & (F.octet_length(t) >= 6))
    return F.when(F.size(own) > 0, F.substring(F.try_element_at(own, F.lit(-1)), F.lit(6), F.lit(2**31 - 1)))


def header(lines: DataFrame) -> DataFrame:
    """(contig, contig_len) of @SQ lines; of a name that repeats, the last line counts; lines without a number are left out.

    SN and LN are found at any place in the line; of several, the last. ``place`` is the lines' order if it is given; else
    the order of reading is, which follows the file.
    """
    own = lines.filter(F.startswith("value", F.lit("@SQ\t")))
    own = own.select(F.split("value", "\t").alias("f"), (c("place") if "place" in lines.columns else F.monotonically_increasing_id()).alias("place"))
    field = lambda name: F.substring(F.try_element_at(F.filter("f", lambda t: F.startswith(t, F.lit(name + ":"))), F.lit(-1)), F.lit(4), F.lit(2**31 - 1))
    named = own.select(field("SN").alias("contig"), natural(field("LN")).alias("contig_len"), "place").filter("contig is not null and contig_len is not null")
    return named.groupBy("contig").agg(F.max_by("contig_len", "place").alias("contig_len"))


def records(lines: DataFrame) -> DataFrame:
    """Fields and tags of record lines, as text; other columns are kept."""
    more = [x for x in lines.columns if x != "value"]
    own = lines.filter(~F.startswith("value", F.lit("@")))
    own = own.select("*", F.explode(F.array(F.split("value", "\t", 12))).alias("__f"))
    return own.select(*more, "value", F.size("__f").alias("n_fields"), *[F.get("__f", F.lit(i)).alias(n) for i, n in enumerate(FIELDS)], F.coalesce(F.get("__f", F.lit(11)), F.lit("")).alias("tags"))


def query_name() -> Column:
    """Paired reads get /1 or /2."""
    f = c("flag")
    paired = f.bitwiseAND(1) != 0
    return F.when(paired & (f.bitwiseAND(0x40) != 0), F.concat("qname", F.lit("/1"))).when(paired & (f.bitwiseAND(0x80) != 0), F.concat("qname", F.lit("/2"))).otherwise(c("qname"))


def is_unmapped() -> Column:
    return (c("rname") == "*") | (c("flag").bitwiseAND(4) != 0) | (c("cigar") == "*")


def is_kept(which: str = "primary-supp") -> Column:
    """By flags: primary-supp leaves out secondary records, primary also supplementary ones."""
    if which not in RECORDS:
        raise ValueError(f"records is one of {RECORDS}")
    mask = {"all": 0, "primary-supp": 0x100, "primary": 0x900}[which]
    return c("flag").bitwiseAND(F.lit(mask)) == 0


def convert(lines: DataFrame, which: str = "primary-supp", long_cs: bool = False, keep_unmapped: bool = True, any_end: bool = False) -> tuple[DataFrame, DataFrame]:
    """(PAF rows with all tags, records set apart with a reason; reasons that begin with ``fatal`` must stop a run).

    ``any_end``: alignments that end behind their contig are kept as they stand.
    """
    more = [x for x in lines.columns if x != "value"]
    typed = records(lines).withColumns({"flag_text": c("flag"), "flag": natural(c("flag"), 2**32 - 1), "pos": natural(c("pos"))})
    early = (
        F.when(c("n_fields") < 11, "fewer than 11 fields")
        .when(c("flag").isNull(), "FLAG is no number")
        .when((c("seq") != "*") & (c("qual") != "*") & (F.octet_length("seq") != F.octet_length("qual")), "SEQ and QUAL differ in length")
    )
    judged = typed.withColumn("reason", early)
    sound = judged.filter("reason is null")
    away = judged.filter("reason is not null").select(*more, c("value").alias("line"), "reason")

    zero, star = F.lit(0).cast("bigint"), F.lit("*")
    blank = {
        "query_name": query_name(), "query_len": F.octet_length("seq").cast("bigint"), "query_start": zero, "query_end": zero, "strand": star, "target_name": star, "target_len": zero,
        "target_start": zero, "target_end": zero, "n_residue_matches": zero, "aln_block_len": zero, "mapq": zero, "tp_tag": star, "nm": F.lit(None).cast("bigint"), "mm": zero,
        "as_tag": F.lit(None).cast("bigint"), "ms_tag": F.lit(None).cast("bigint"), "ts_raw": F.lit(None).cast("string"), "xs_raw": F.lit(None).cast("string"),
        "gap_bases": zero, "gap_count": zero, "cg": F.lit(None).cast("string"), "cs": F.lit(""),
    }
    unmapped = sound.filter(is_unmapped()).select(*more, *[x.alias(n) for n, x in blank.items()])

    contigs = header(lines)
    few = contigs.limit(BROADCAST_CONTIGS + 1).count() <= BROADCAST_CONTIGS
    kept = sound.filter(~is_unmapped() & is_kept(which)).join(F.broadcast(contigs) if few else contigs, c("rname") == c("contig"), "left")
    # generated, not projected, so that no filter is pushed below with the statistics in each of its terms
    kept = kept.select("*", F.explode(F.array(G.stats(c("cigar")))).alias("s"))
    given, md = _tag(c("tags"), "cs"), _tag(c("tags"), "MD")
    rebuilt = G.rebuild_cs(long_cs)
    need = given.isNull() & md.isNotNull() & (c("seq") != "*")
    kept = kept.withColumns({"given": given, "md": md}).withColumn("rebuilt", rebuilt(F.when(need, c("cigar")), c("md"), c("seq")))
    start = c("pos") - 1
    late = (
        F.when(c("contig_len").isNull(), "contig is not in the header")
        .when(c("pos").isNull() | (c("pos") < 1), "POS is no place")
        .when(F.lit(not any_end) & (start + c("s.ref_len") > c("contig_len")), "alignment ends behind its contig")
        .when((c("seq") != "*") & (F.octet_length("seq") != c("s.query_consumed")), "SEQ and CIGAR differ in length")
        .when(natural(c("mapq"), 2**32 - 1).isNull(), "MAPQ is no number")
        .when(c("given").isNotNull(), F.lit(None).cast("string"))
        .when(c("md").isNull(), F.concat(F.lit("fatal: mapped read "), c("qname"), F.lit(" has no cs:Z or MD tag")))
        .when(c("seq") == "*", F.concat(F.lit("fatal: mapped read "), c("qname"), F.lit(" has an MD tag but SEQ is '*'")))
        .when(c("rebuilt.cs").isNull(), F.concat(F.lit("fatal: read "), c("qname"), F.lit(": "), F.coalesce("rebuilt.error", F.lit(""))))
    )
    kept = kept.select("*", F.explode(F.array(F.struct(late.alias("reason")))).alias("__late")).drop("reason").withColumn("reason", c("__late.reason"))
    away = away.unionByName(kept.filter("reason is not null").select(*more, c("value").alias("line"), "reason"))
    nm, mm = G.calibrated(c("s"), natural(_tag(c("tags"), "NM")))
    turned = c("flag").bitwiseAND(0x10) != 0
    number = lambda name: F.coalesce(_tag(c("tags"), name).try_cast("bigint"), F.lit(None).cast("bigint"))
    whole = {
        "query_name": query_name(), "query_len": c("s.query_len"), "query_start": F.when(turned, c("s.trail")).otherwise(c("s.lead")),
        "query_end": c("s.query_len") - F.when(turned, c("s.lead")).otherwise(c("s.trail")), "strand": F.when(turned, "-").otherwise("+"), "target_name": c("rname"), "target_len": c("contig_len"),
        "target_start": start, "target_end": start + c("s.ref_len"), "n_residue_matches": F.greatest(c("s.m") - mm, zero), "aln_block_len": c("s.block_len"), "mapq": natural(c("mapq")),
        "tp_tag": F.when(c("flag").bitwiseAND(0x100) != 0, "S").otherwise("P"), "nm": nm, "mm": mm, "as_tag": number("AS"), "ms_tag": number("ms"), "ts_raw": F.left(_tag(c("tags"), "ts"), F.lit(1)),
        "xs_raw": F.left(_tag(c("tags"), "XS"), F.lit(1)), "gap_bases": c("s.i_bases") + c("s.d_bases"), "gap_count": c("s.i_count") + c("s.d_count"), "cg": G.without_clips(c("cigar")),
        "cs": F.coalesce("given", "rebuilt.cs"),
    }
    mapped = kept.filter("reason is null").select(*more, *[x.alias(n) for n, x in whole.items()])
    rows = mapped.unionByName(unmapped) if keep_unmapped else mapped
    return rows.withColumn("line", paf_line()), away


def paf_line() -> Column:
    """A row as PAF text; tags in fixed order, absent ones left out, none for unmapped rows."""
    from weft import schema

    head = [c(n).cast("string") for n in schema.names(schema.PAF_COLUMNS)]
    tag = lambda name, x: F.concat(F.lit(name + ":"), x.cast("string"))
    known = F.when(c("nm").isNotNull(), F.concat(tag("NM:i", c("nm")), F.lit("\t"), tag("mm:i", c("mm"))))
    full = F.concat_ws(
        "\t", *head, tag("tp:A", c("tp_tag")), known, tag("AS:i", c("as_tag")), tag("ms:i", c("ms_tag")), tag("ts:A", c("ts_raw")), tag("XS:A", c("xs_raw")),
        tag("gn:i", c("gap_bases")), tag("go:i", c("gap_count")), tag("cg:Z", c("cg")), tag("cs:Z", c("cs")),
    )
    return F.when(c("cg").isNull(), F.concat_ws("\t", *head)).otherwise(full)


def as_alignments(rows: DataFrame) -> DataFrame:
    """Converted rows with the columns that a PAF source gives."""
    from weft import schema

    zero = F.lit(0).cast("bigint")
    more = [x for x in ("place",) if x in rows.columns]
    return rows.select(
        *more, *schema.names(schema.PAF_COLUMNS), F.coalesce("ms_tag", zero).alias("ms_score"), F.coalesce("as_tag", zero).alias("as_score"), "cs", "tp_tag",
        F.coalesce("ts_raw", F.lit("*")).alias("ts_tag"), F.coalesce("xs_raw", F.lit("*")).alias("xs_tag"), "line",
    )


def stop_if_fatal(away: DataFrame) -> None:
    row = away.filter(F.startswith("reason", F.lit("fatal"))).limit(1).collect()
    if row:
        stop(row[0]["reason"])


def stop(reason: str) -> None:
    raise NoDifferenceString(reason.removeprefix("fatal: ") + "; align with cs output, add MD tags, or leave out secondary alignments")


def read_sam(spark: SparkSession, path: str, which: str = "primary-supp", long_cs: bool = False, keep_unmapped: bool = True) -> DataFrame:
    rows, away = convert(read_lines(spark, path), which, long_cs, keep_unmapped)
    stop_if_fatal(away)
    return as_alignments(rows)
