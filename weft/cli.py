"""``python -m weft``: the commands on the command line."""

from __future__ import annotations

import argparse
import logging
import sys

from weft.plans import commands
from weft.sources.sam import RECORDS


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weft", description="Compare two sets of alignments of the same reads.")
    sub = top.add_subparsers(dest="command", required=True)

    def sorting(p: argparse.ArgumentParser) -> None:
        p.add_argument("--sort-mem", default="1G", help="accepted and checked; Spark sizes its own sorts")
        p.add_argument("--sort-tmp-dir", help="accepted; Spark has its own folders")
        p.add_argument("--sort-threads", type=int, default=1, help="accepted; Spark has its own tasks")
        p.add_argument("--presorted", action="store_true")
        p.add_argument("--keep-sorted-paf", action="store_true")

    def labels(p: argparse.ArgumentParser) -> None:
        p.add_argument("--label-a", default="SetA", type=commands.check_label)
        p.add_argument("--label-b", default="SetB", type=commands.check_label)

    def folder(p: argparse.ArgumentParser) -> None:
        p.add_argument("-o", "--outdir", required=True)
        p.add_argument("-p", "--prefix", required=True)

    p = sub.add_parser("compare", help="alignments to the comparison table")
    p.add_argument("-a", "--aln-a", required=True)
    p.add_argument("-b", "--aln-b", required=True)
    labels(p)
    folder(p)
    p.add_argument("--format", choices=("tsv", "parquet", "both"), default="parquet")
    p.add_argument("--allow-id-mismatch", action="store_true")
    p.add_argument("--emit-alninfo", action="store_true")
    p.add_argument("--emit-readinfo", action="store_true")
    p.add_argument("--sam-records-to-convert", choices=RECORDS)
    sorting(p)

    p = sub.add_parser("sam2paf", help="SAM or BAM to PAF")
    p.add_argument("input", nargs="?", default="-")
    p.add_argument("-p", dest="primary_supp", action="store_true", help="leave out secondary records")
    p.add_argument("-P", dest="primary", action="store_true", help="leave out secondary and supplementary records")
    p.add_argument("-L", dest="long_cs", action="store_true", help="bases of matches in rebuilt cs strings")
    p.add_argument("-U", dest="unmapped", action="store_true", help="keep unmapped records")

    tool = sub.add_parser("toolkit", help="the steps by themselves").add_subparsers(dest="tool", required=True)
    p = tool.add_parser("paf2tables")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("--alninfo")
    p.add_argument("-r", "--readinfo")
    sorting(p)
    p = tool.add_parser("compare-readinfo")
    p.add_argument("-a", "--readinfo-a", required=True)
    p.add_argument("-b", "--readinfo-b", required=True)
    labels(p)
    p.add_argument("-o", "--output", default="-")
    p.add_argument("--allow-id-mismatch", action="store_true")
    p = tool.add_parser("alninfo2readinfo")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", default="-")
    p = tool.add_parser("compare-summary")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("--input-format", choices=("auto", "tsv", "parquet"), default="auto")
    p.add_argument("-o", "--output")
    p = tool.add_parser("find-aln-diff")
    p.add_argument("-i", "--input", required=True)
    folder(p)
    p.add_argument("--mode", choices=("any-diff-query", "any-diff-reference"), default="any-diff-query")
    p.add_argument("--aligned-both-only", action="store_true")
    p.add_argument("--emit-identical-reads", action="store_true")
    p.add_argument("--no-gzip", action="store_true")
    p = tool.add_parser("query-junction-compare")
    p.add_argument("-i", "--input", required=True)
    folder(p)
    p.add_argument("--emit-all-junctions", action="store_true")
    p = tool.add_parser("genomic-junction-compare")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("--input-format", choices=("auto", "tsv", "parquet"), default="auto")
    folder(p)
    p = tool.add_parser("read-overlap", help="counts of read names of two files")
    p.add_argument("-a", required=True)
    p.add_argument("-b", required=True)
    return top


def run(spark, args: argparse.Namespace) -> commands.Result:
    """Carry out parsed arguments."""
    if args.command == "compare":
        return commands.compare(
            spark, args.aln_a, args.aln_b, args.outdir, args.prefix, args.label_a, args.label_b, args.format, args.allow_id_mismatch, args.presorted,
            args.emit_alninfo, args.emit_readinfo, args.keep_sorted_paf, args.sam_records_to_convert, args.sort_mem,
        )
    if args.command == "sam2paf":
        records = "primary" if args.primary else "primary-supp" if args.primary_supp else "all"
        return commands.sam2paf(spark, args.input, "-", records, args.long_cs, args.unmapped)
    if args.tool == "paf2tables":
        commands.parse_memory(args.sort_mem)
        return commands.paf2tables(spark, args.input, args.alninfo, args.readinfo, args.presorted, args.keep_sorted_paf)
    if args.tool == "compare-readinfo":
        return commands.compare_readinfo(spark, args.readinfo_a, args.readinfo_b, args.output, args.label_a, args.label_b, args.allow_id_mismatch)
    if args.tool == "alninfo2readinfo":
        return commands.readinfo_of_alninfo(spark, args.input, args.output)
    if args.tool == "compare-summary":
        return commands.compare_summary(spark, args.input, args.input_format, args.output)
    if args.tool == "find-aln-diff":
        return commands.find_aln_diff(spark, args.input, args.outdir, args.prefix, args.mode, args.aligned_both_only, args.emit_identical_reads, not args.no_gzip)
    if args.tool == "query-junction-compare":
        return commands.query_junction_compare(spark, args.input, args.outdir, args.prefix, args.emit_all_junctions)
    if args.tool == "read-overlap":
        return commands.read_overlap(spark, args.a, args.b)
    return commands.genomic_junction_compare(spark, args.input, args.outdir, args.prefix, args.input_format)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="[%(levelname)s] %(message)s")
    for noisy in ("py4j", "pyspark"):
        logging.getLogger(noisy).setLevel(logging.WARNING)
    spark = SparkSession.builder.appName("weft").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args)
    except (ValueError, OSError) as error:
        logging.getLogger("weft").error("%s", error)
        return 1
    return 0
