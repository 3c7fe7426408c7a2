"""One way to any alignment file, by what is in it."""

from __future__ import annotations

import logging
import shutil
import sys
import tempfile
import uuid
from collections import Counter
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.sources import paf, sam
from weft.sources.bam import read_bam_lines
from weft.sources.files import head_of as _head
from weft.sources.files import place_of

log = logging.getLogger("weft")


def detect(path: str) -> str:
    """``bam``, ``sam`` or ``paf``; CRAM is refused. What is no BAM and doesn't begin like SAM is PAF."""
    head = _head(path)
    if head[:4] == b"BAM\x01":
        return "bam"
    if head[:4] == b"CRAM":
        raise ValueError(f"{path} is CRAM, which isn't read; convert it to BAM or SAM")
    first = head.split(b"\n", 1)[0].rstrip(b"\r")
    if first[:4] in (b"@HD\t", b"@SQ\t", b"@RG\t", b"@PG\t", b"@CO\t"):
        return "sam"
    fields = first.split(b"\t")
    looks = len(fields) >= 11 and fields[1].isdigit() and fields[3].isdigit() and fields[4].isdigit() and not (len(fields) > 4 and fields[4] in (b"+", b"-"))
    return "sam" if looks else "paf"


def sort_order(path: str) -> str | None:
    """SO of the @HD line, if there is one."""
    head = _head(path)
    if head[:4] == b"BAM\x01":
        head = head[8 : 8 + int.from_bytes(head[4:8], "little")]
    for line in head.split(b"\n"):
        if line.startswith(b"@HD\t"):
            for field in line.rstrip(b"\r").split(b"\t"):
                if field.startswith(b"SO:"):
                    return field[3:].decode()
    return None


def spooled(path: str) -> str:
    """``-`` is standard input, kept in a temporary file of the driver's machine; for local sessions."""
    if path != "-":
        return path
    with tempfile.NamedTemporaryFile(delete=False, suffix=".txt") as file:
        shutil.copyfileobj(sys.stdin.buffer, file)
    return file.name


def sam_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) or (value, place) of SAM or BAM."""
    return read_bam_lines(spark, path) if detect(path) == "bam" else paf.read_lines(spark, path)


def load_alignments(spark: SparkSession, path: str, records: str = "primary-supp", in_order: bool = False) -> DataFrame:
    """The alignments of a PAF, SAM or BAM file, with the columns of ``paf.parse``. ``in_order``: with ``place``."""
    if detect(path) == "paf":
        return paf.parse(paf.with_place(spark, path) if in_order else paf.read_lines(spark, path))[0]
    lines = sam_lines(spark, path)
    if not in_order and "place" in lines.columns:
        lines = lines.drop("place")
    elif in_order and "place" not in lines.columns:
        lines = paf.with_place(spark, path)
    rows, away = sam.convert(lines, records)
    sam.stop_if_fatal(away)
    return sam.as_alignments(rows)


@contextmanager
def staged(spark: SparkSession, path: str, records: str, folder: str, in_order: bool = False, kind: str | None = None):
    """(alignments, names of all lines) of a file, with a warning for what is left out.

    SAM and BAM are decoded once and converted once, to Parquet in a hidden folder below ``folder``, which goes at the end.
    """
    if (kind or detect(path)) == "paf":
        lines = paf.with_place(spark, path) if in_order else paf.read_lines(spark, path)
        rows, away = paf.parse(lines)
        warn(path, away, "malformed lines are left out")
        yield rows, paf.line_names(lines)
        return
    fs, place = place_of(f"{folder}/.weft-{uuid.uuid4().hex}")
    try:
        lines = sam_lines(spark, path)
        if "place" not in lines.columns and in_order:
            lines = paf.with_place(spark, path)
        lines.write.parquet(place.suffix("-lines").toString())
        rows, away = sam.convert(spark.read.parquet(place.suffix("-lines").toString()), records)
        warn(path, away, "records are left out")
        sam.as_alignments(rows).write.parquet(place.suffix("-rows").toString())
        found = spark.read.parquet(place.suffix("-rows").toString())
        yield found, found.select("query_name")
    finally:
        for part in ("-lines", "-rows"):
            fs.delete(place.suffix(part), True)


def warn(path: str, away: DataFrame, what: str) -> int:
    """Counts rejects by reason in one pass, warns of them, and stops at a fatal one."""
    kinds = F.when(F.startswith("reason", F.lit("fatal")), "fatal").otherwise(F.col("reason"))
    found = Counter({r["kind"]: (r["n"], r["first"]) for r in away.groupBy(kinds.alias("kind")).agg(F.count("*").alias("n"), F.min("reason").alias("first")).collect()})  # one row a reason
    if "fatal" in found:
        sam.stop(found["fatal"][1])
    n = sum(k for k, _ in found.values())
    if n:
        log.warning("%s: %d %s: %s", path, n, what, ", ".join(f"{k} {reason}" for reason, (k, _) in sorted(found.items())))
    return n


def load_names(spark: SparkSession, path: str, records: str = "primary-supp") -> DataFrame:
    """(query_name) of all lines: PAF lines that are malformed count too."""
    if detect(path) == "paf":
        return paf.line_names(paf.read_lines(spark, path))
    return load_alignments(spark, path, records).select("query_name")


def n_rejected(spark: SparkSession, path: str, records: str = "primary-supp") -> int:
    """Lines or records that are left out, with a warning."""
    if detect(path) == "paf":
        return warn(path, paf.parse(paf.read_lines(spark, path))[1], "malformed lines are left out")
    return warn(path, sam.convert(sam_lines(spark, path), records)[1], "records are left out")
