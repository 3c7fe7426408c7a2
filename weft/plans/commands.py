"""The eight commands: files in, files out. Each is also a function over DataFrames in ``weft.operators``."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft import schema, sinks
from weft.operators import classify as K
from weft.operators import collapse, features, pair, regions
from weft.operators import compare as P
from weft.operators import junctions as J
from weft.sources import load, sam, tables
from weft.sources.files import make_folder

log = logging.getLogger("weft")
c = F.col
SIDE_TEXT = {f"{n}_{s}" for n, kind in schema.SIDE if kind == "s" for s in "AB"} | {"query_junctions_only_A", "query_junctions_only_B"}
BRIEF = {"label_A", "label_B", "reads_compared", "aligned_both", "aligned_only_A", "aligned_only_B", "aligned_neither", "query_identical", "query_not_identical"}


@dataclass
class Result:
    """What a command wrote, and its summary."""

    paths: dict[str, str] = field(default_factory=dict)
    summary: list[tuple[str, object]] = field(default_factory=list)


def check_label(label: str) -> str:
    if not label or re.search(r"[\t\n\r/\\]", label):
        raise ValueError(f"{label!r} is no label: labels are part of file names, so not empty and without tabs, line ends and slashes")
    return label


def check_labels(label_a: str, label_b: str) -> None:
    if check_label(label_a) == check_label(label_b):
        raise ValueError(f"both labels are {label_a!r}; they name the sets' files, so they must differ")


def parse_memory(size: str) -> int:
    """Bytes of ``1G``, ``512M``, ``64K`` or a plain number. Spark sizes its own sorts; the value is only checked."""
    found = re.fullmatch(r"\s*([0-9]+)\s*([KkMmGg]?)[Bb]?\s*", size)
    if not found:
        raise ValueError(f"{size!r} is no size such as 1G")
    return int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[found[2].lower()]


def input_stem(path: str) -> str:
    name = Path(path).name
    return re.sub(r"(\.paf|\.sam|\.bam|\.tsv)?(\.gz)?$", "", name) or name


def pairs_of(frame: DataFrame, labels: tuple[str, str]) -> list[tuple[str, object]]:
    """Labels, then a summary's rows; summaries have under twenty."""
    return [("label_A", labels[0]), ("label_B", labels[1]), *[(r["category"], r["count"]) for r in frame.collect()]]


def _beside(path: str | None) -> str:
    """The folder of a file; that of the run for standard output."""
    return path.rpartition("/")[0] or ("/" if path.startswith("/") else ".") if path and path != "-" else "."


def _same_order(a: DataFrame, b: DataFrame) -> None:
    """Reads of both sets come in the same order, each in one run of lines."""
    first = lambda x: x.groupBy("query_name").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"))
    from pyspark.sql import Window

    def ranked(x: DataFrame) -> DataFrame:
        # ranks over a whole set need one order: the check is for files whose order matters, not for the default path
        return x.select("query_name", F.row_number().over(Window.orderBy("first")).alias("rank"))

    runs_a, runs_b = first(a), first(b)
    for rows, name in ((a, "A"), (b, "B")):
        before = F.lag("query_name").over(Window.orderBy("place"))
        starts = rows.select("query_name", before.alias("p")).filter(c("p").isNull() | (c("p") != c("query_name")))
        torn = starts.groupBy("query_name").count().filter("count > 1").limit(1).collect()
        if torn:
            raise pair.ReadSetMismatch(f"presorted: lines of read {torn[0]['query_name']} of set {name} aren't together")
    both = ranked(runs_a).join(ranked(runs_b).withColumnRenamed("rank", "rank_b"), "query_name", "full")
    wrong = both.filter(c("rank").isNull() | c("rank_b").isNull() | (c("rank") != c("rank_b"))).orderBy(F.coalesce("rank", "rank_b")).limit(1).collect()
    if wrong:
        raise pair.ReadSetMismatch(f"presorted: the sets part at read {wrong[0]['query_name']}; both must hold the same reads in the same order")


def write_comparison(table: DataFrame, base: str, form: str, paths: dict[str, str]) -> None:
    if form in ("parquet", "both"):
        paths["parquet"] = f"{base}.parquet"
        sinks.write_comparison_parquet(table, paths["parquet"])
    if form in ("tsv", "both"):
        paths["tsv"] = f"{base}.tsv.gz"
        sinks.write_text(table, paths["tsv"], ["query_name"], escape=SIDE_TEXT)


def compare(
    spark: SparkSession, aln_a: str, aln_b: str, outdir: str, prefix: str, label_a: str = "SetA", label_b: str = "SetB", form: str = "parquet", allow_id_mismatch: bool = False,
    presorted: bool = False, emit_alninfo: bool = False, emit_readinfo: bool = False, keep_sorted_paf: bool = False, records: str | None = None, sort_mem: str = "1G",
) -> Result:
    """Two alignment files, read by read: the comparison table and its summary, and on demand the tables it is made of."""
    check_labels(label_a, label_b)
    parse_memory(sort_mem)
    if presorted and (allow_id_mismatch or keep_sorted_paf):
        raise ValueError("presorted goes with neither allow_id_mismatch nor keep_sorted_paf")
    if "-" in (aln_a, aln_b):
        raise ValueError("compare reads its inputs more than once, so not from standard input")
    if form not in ("tsv", "parquet", "both"):
        raise ValueError("form is tsv, parquet or both")
    out = make_folder(outdir)
    kinds = [load.detect(p) for p in (aln_a, aln_b)]
    if records and set(kinds) == {"paf"}:
        log.warning("the choice of SAM records has no effect: both inputs are PAF")
    records = records or "primary-supp"
    for path, kind in zip((aln_a, aln_b), kinds):
        if presorted and kind != "paf" and load.sort_order(path) == "coordinate":
            raise ValueError(f"presorted: {path} is sorted by coordinate; sort both by name, or drop presorted")
    with load.staged(spark, aln_a, records, out, presorted, kinds[0]) as (a, names_a), load.staged(spark, aln_b, records, out, presorted, kinds[1]) as (b, names_b):
        made = _compared(spark, a, b, names_a, names_b, out, prefix, label_a, label_b, form, allow_id_mismatch, presorted, emit_alninfo, emit_readinfo, keep_sorted_paf)
    sinks.show_summary(made.summary, "Comparison summary", BRIEF)
    return made


def _compared(
    spark: SparkSession, a: DataFrame, b: DataFrame, names_a: DataFrame, names_b: DataFrame, out: str, prefix: str, label_a: str, label_b: str, form: str, allow_id_mismatch: bool,
    presorted: bool, emit_alninfo: bool, emit_readinfo: bool, keep_sorted_paf: bool,
) -> Result:
    only = (0, 0)
    if presorted:
        _same_order(a, b)
    else:
        found = pair.check_ids(names_a, names_b) if allow_id_mismatch else pair.require_same_ids(names_a, names_b, label_a, label_b)
        only = (found.n_only_a, found.n_only_b)
    tie = "place" if presorted else "line"
    made = Result()
    base = f"{out}/{prefix}"
    paths = {"summary": f"{base}.compare.summary.tsv", "parquet": f"{base}.compare.parquet" if form != "tsv" else "", "tsv": f"{base}.compare.tsv.gz" if form != "parquet" else ""}
    for label in (label_a, label_b):
        paths |= {f"{label}.alninfo": f"{base}.{label}.alninfo.tsv.gz" if emit_alninfo else "", f"{label}.readinfo": f"{base}.{label}.readinfo.tsv.gz" if emit_readinfo else "", f"{label}.sorted": f"{base}.{label}.sorted.paf.gz" if keep_sorted_paf else ""}
    made.paths = {k: v for k, v in paths.items() if v}
    reads = [collapse.escaped(features.derive(collapse.representatives(x, tie)).withColumn("cs", collapse.X.escape(c("cs")))) for x in (a, b)]
    with sinks.all_or_nothing(list(made.paths.values())):
        table = P.compare(reads[0], reads[1], label_a, label_b)
        if form != "tsv":
            # later results are read from the table at rest: nothing is computed twice
            sinks.write_comparison_parquet(table, paths["parquet"])
            table = spark.read.parquet(paths["parquet"])
        else:
            table = table.persist()
        if form != "parquet":
            sinks.write_text(table, paths["tsv"], ["query_name"], escape=SIDE_TEXT)
        for label, alignments, info in ((label_a, a, reads[0]), (label_b, b, reads[1])):
            if emit_alninfo:
                sinks.write_text(_ordered_alninfo(alignments, tie), paths[f"{label}.alninfo"], [])
            if emit_readinfo:
                sinks.write_text(info, paths[f"{label}.readinfo"], ["query_name"])
            if keep_sorted_paf:
                sinks.write_lines(alignments, paths[f"{label}.sorted"])
        summary = K.summary(K.classify(K.classify_columns(table)), *only)
        made.summary = pairs_of(summary, (label_a, label_b))
        sinks.write_summary(made.summary, paths["summary"])
        if form == "tsv":
            table.unpersist()
    return made


def _ordered_alninfo(alignments: DataFrame, tie: str) -> DataFrame:
    ordered = features.derive(alignments).withColumn("cs", collapse.X.escape(c("cs"))).orderBy(*(["place"] if tie == "place" else ["line"]))
    return ordered.select(*schema.names(schema.ALNINFO))


def sam2paf(spark: SparkSession, path: str, out: str = "-", records: str = "all", long_cs: bool = False, keep_unmapped: bool = False) -> Result:
    """SAM or BAM as PAF text in the input's order."""
    path = load.spooled(path)
    lines = load.sam_lines(spark, path)
    if "place" not in lines.columns:
        from weft.sources.paf import with_place

        lines = with_place(spark, path)
    rows, away = sam.convert(lines, records, long_cs, keep_unmapped)
    load.warn(path, away, "records are skipped")
    sinks.write_lines(rows, out, ["place"])
    return Result({"paf": out})


def paf2tables(spark: SparkSession, path: str, alninfo: str | None = None, readinfo: str | None = None, presorted: bool = False, keep_sorted_paf: bool = False) -> Result:
    """The table of alignments and that of reads of one PAF file."""
    if not alninfo and not readinfo:
        raise ValueError("ask for alninfo, readinfo or both")
    if presorted and keep_sorted_paf:
        raise ValueError("presorted input isn't sorted, so there is no sorted PAF to keep")
    path = load.spooled(path)
    rows = load.load_alignments(spark, path, in_order=presorted)
    load.n_rejected(spark, path)
    tie = "place" if presorted else "line"
    if presorted:
        from weft.sources.paf import order_violations

        wrong = order_violations(rows).limit(1).collect()
        if wrong:
            raise ValueError(f"presorted: read {wrong[0]['query_name']} follows a greater name")
    made = Result({k: v for k, v in (("alninfo", alninfo), ("readinfo", readinfo)) if v})
    if keep_sorted_paf:
        made.paths["sorted"] = f"{_beside(alninfo or readinfo)}/{input_stem(path)}.sorted.paf.gz"
    with sinks.all_or_nothing(list(made.paths.values())):
        if alninfo:
            sinks.write_text(_ordered_alninfo(rows, tie), alninfo, [])
        if readinfo:
            info = collapse.escaped(features.derive(collapse.representatives(rows, tie)).withColumn("cs", collapse.X.escape(c("cs"))))
            sinks.write_text(info, readinfo, ["query_name"])
        if keep_sorted_paf:
            sinks.write_lines(rows, made.paths["sorted"])
    return made


def readinfo_of_alninfo(spark: SparkSession, path: str, out: str) -> Result:
    """The table of reads from one of alignments."""
    rows = tables.read_alninfo(spark, path)
    sinks.write_text(collapse.readinfo_from_alninfo(rows, "place"), out, ["query_name"])
    return Result({"readinfo": out})


def compare_readinfo(spark: SparkSession, readinfo_a: str, readinfo_b: str, out: str, label_a: str = "SetA", label_b: str = "SetB", allow_id_mismatch: bool = False) -> Result:
    """The comparison table of two tables of reads; Parquet if ``out`` ends so, else text. Names that repeat pair in order."""
    check_labels(label_a, label_b)
    a, b = (tables.read_readinfo(spark, p, s) for p, s in ((readinfo_a, "A"), (readinfo_b, "B")))
    # names pair by occurrence, so the check counts occurrences too
    keyed = [pair.numbered(x, "place").select(F.concat_ws("\x00", "query_name", c("__nth").cast("string")).alias("query_name")) for x in (a, b)]
    found = pair.check_ids(*keyed)
    if (found.n_only_a or found.n_only_b) and not allow_id_mismatch:
        first = [x.split("\x00")[0] for x in (*found.examples_a, *found.examples_b)]
        raise pair.ReadSetMismatch(f"read sets differ: {found.n_shared} shared, {found.n_only_a} only in {label_a}, {found.n_only_b} only in {label_b}; first at read {min(first)}")
    with sinks.all_or_nothing([out]):
        table = P.compare(a, b, label_a, label_b, order="place")
        if out.endswith(".parquet"):
            sinks.write_comparison_parquet(table, out)
            table = spark.read.parquet(out)
        else:
            sinks.write_text(table, out, ["query_name"], escape=SIDE_TEXT)
        summary = pairs_of(K.summary(K.classify(K.classify_columns(table)), found.n_only_a, found.n_only_b), (label_a, label_b))
    sinks.show_summary(summary, "Comparison summary", BRIEF)
    return Result({"table": out}, summary)


def compare_summary(spark: SparkSession, path: str, form: str = "auto", out: str | None = None) -> Result:
    """The counts of a comparison table."""
    wanted = ["query_name", *schema.sided(schema.CLASSIFY_SIDE, "A"), *schema.sided(schema.CLASSIFY_SIDE, "B")]
    rows = tables.read_comparison(spark, load.spooled(path), form, wanted)
    pairs = pairs_of(K.summary(K.classify(rows)), tables.labels_of(rows))
    if out:
        sinks.write_summary(pairs, out)
    sinks.show_summary(pairs, "Comparison summary")
    return Result({"summary": out} if out else {}, pairs)


def find_aln_diff(spark: SparkSession, path: str, outdir: str, prefix: str, mode: str = "any-diff-query", both_only: bool = False, emit_identical: bool = False, gzip: bool = True) -> Result:
    """Reads whose alignments differ, the regions in which they lie, and a summary."""
    wanted = ["query_name", *schema.sided(schema.CLASSIFY_SIDE, "A"), *schema.sided(schema.CLASSIFY_SIDE, "B")]
    rows = tables.read_comparison(spark, path, columns=wanted, parquet_only=True)
    labels = tables.labels_of(rows)
    base, end = f"{make_folder(outdir)}/{prefix}", ".gz" if gzip else ""
    stem = {"any-diff-query": "query_aln", "any-diff-reference": "reference_aln"}[mode]
    paths = {"reads": f"{base}.{stem}_diff_reads.tsv{end}", "regions_A": f"{base}.{stem}_diff_regions.A.bed{end}", "regions_B": f"{base}.{stem}_diff_regions.B.bed{end}", "summary": f"{base}.{stem}_diff_summary.tsv"}
    if emit_identical:
        paths["identical"] = f"{base}.{stem}_identical_reads.tsv{end}"
    decided = regions.decided(rows, mode, both_only).persist()
    with sinks.all_or_nothing(list(paths.values())):
        sinks.write_text(regions.reads(decided), paths["reads"], ["query_name"])
        if emit_identical:
            sinks.write_text(regions.reads(decided, identical=True), paths["identical"], ["query_name"])
        found = {s: regions.regions(decided, s).persist() for s in "AB"}
        for s, region in found.items():
            sinks.write_text(region, paths[f"regions_{s}"], ["chrom", "start"], names=["#chrom", *region.columns[1:]])
            if bad := regions.n_bad_intervals(decided, s):
                log.warning("%d reads of side %s have no proper interval and are in no region", bad, s)
        pairs = pairs_of(regions.summary(decided, found["A"], found["B"], mode, both_only), labels)
        sinks.write_summary(pairs, paths["summary"])
    for x in (decided, *found.values()):
        x.unpersist()
    sinks.show_summary(pairs, "Difference summary")
    return Result(paths, pairs)


def _flags(frame: DataFrame) -> DataFrame:
    """True and false as 1 and 0, as these tables print them."""
    return frame.select(*[c(n).cast("int").alias(n) if kind == "boolean" else c(n) for n, kind in frame.dtypes])


def query_junction_compare(spark: SparkSession, path: str, outdir: str, prefix: str, emit_all: bool = False) -> Result:
    """Junctions of reads whose query junctions differ, each side's catalog, and a summary. The table is read once."""
    wanted = ["query_name", "query_len", "n_query_junctions_only_A", "n_query_junctions_only_B", *schema.sided(schema.QJC_SIDE, "A"), *schema.sided(schema.QJC_SIDE, "B")]
    table = tables.read_comparison(spark, path, columns=wanted, parquet_only=True)
    labels = tables.labels_of(table)
    base = f"{make_folder(outdir)}/{prefix}.query_junction_compare"
    paths = {"summary": f"{base}.summary.tsv", "per_read": f"{base}.per_read_per_junc_info.tsv.gz", **{f"unmatched_{s}": f"{base}.unmatched_junctions.{s}.tsv.gz" for s in "AB"}}
    if emit_all:
        paths |= {f"all_{s}": f"{base}.all_junctions.{s}.tsv.gz" for s in "AB"}
    rows = J.with_query(table)
    both = J.catalogs(rows).persist()
    with sinks.all_or_nothing(list(paths.values())):
        sinks.write_text(_flags(J.read_junctions(rows).select(*J.QJC_READ_COLUMNS)), paths["per_read"], ["query_name", "side", "junction_index"])
        for s in "AB":
            sinks.write_text(J.catalog(both, s, True), paths[f"unmatched_{s}"], J.KEY)
            if emit_all:
                sinks.write_text(J.catalog(both, s, False), paths[f"all_{s}"], J.KEY)
        pairs = pairs_of(J.qjc_summary(rows, both), labels)
        sinks.write_summary(pairs, paths["summary"])
    both.unpersist()
    sinks.show_summary(pairs, "Query junction summary")
    return Result(paths, pairs)


def genomic_junction_compare(spark: SparkSession, path: str, outdir: str, prefix: str, form: str = "auto") -> Result:
    """Junction sets of each read by genomic key, reads by junction, and a summary."""
    wanted = ["query_name", *schema.sided(schema.GJC_SIDE, "A"), *schema.sided(schema.GJC_SIDE, "B")]
    table = tables.read_comparison(spark, load.spooled(path), form, wanted)
    labels = tables.labels_of(table)
    base = f"{make_folder(outdir)}/{prefix}.genomic_junction_compare"
    paths = {"per_read": f"{base}.per_read.tsv.gz", "per_junction": f"{base}.per_junction.tsv.gz", "summary": f"{base}.summary.tsv"}
    rows = J.with_genomic(table)
    junctions = J.per_junction(rows).persist()
    with sinks.all_or_nothing(list(paths.values())):
        sinks.write_text(J.per_read(rows), paths["per_read"], ["query_name"])
        sinks.write_text(junctions, paths["per_junction"], J.KEY)
        pairs = pairs_of(J.gjc_summary(rows, junctions), labels)
        sinks.write_summary(pairs, paths["summary"])
    junctions.unpersist()
    sinks.show_summary(pairs, "Genomic junction summary")
    return Result(paths, pairs)


def read_overlap(spark: SparkSession, path_a: str, path_b: str) -> Result:
    """Distinct read names of two files, of alignments or of tables with a query_name column, and how many they share."""

    def names(path: str) -> DataFrame:
        if path.endswith(".parquet"):
            return spark.read.parquet(path).select("query_name")
        first = load._head(path).split(b"\n", 1)[0].decode(errors="replace")
        if "query_name" in first.split("\t"):
            return tables.read_tsv(spark, path).select("query_name")
        return load.load_names(spark, path)

    found = pair.check_ids(names(path_a), names(path_b))
    pairs: list[tuple[str, object]] = [("n_a", found.n_a), ("n_b", found.n_b), ("n_shared", found.n_shared)]
    sinks.show_summary(pairs, "Read names")
    return Result({}, pairs)
