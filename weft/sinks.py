"""Files of results: ordered text, plain or gzip, and Parquet. Nothing half-written is left behind.

Paths are Hadoop's: any file system that the session knows, the default one without a scheme. Text is sorted by
Spark in ranges, each range is written by its own task to a hidden folder beside the target, and the parts are put
together in order there; gzip files may be joined as they are. A file appears under its name only when whole.
"""

from __future__ import annotations

import gzip
import logging
import sys
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft import schema
from weft.functions import text as X
from weft.sources.files import place_of

log = logging.getLogger("weft")
c = F.col


def cells(frame: DataFrame, escape: set[str] = frozenset()) -> list[Column]:
    """Each column as text: null text is empty, numbers that aren't defined are NaN, numbers have no exponents."""
    made = []
    for name, kind in frame.dtypes:
        if kind == "double":
            made.append(X.plain_number(c(name)))
        elif kind == "boolean":
            made.append(F.coalesce(c(name).cast("string"), F.lit("")))
        else:
            text = F.coalesce(c(name).cast("string"), F.lit(""))
            made.append(X.escape(text) if name in escape else text)
    return made


def _hidden(path: str):
    """(file system, the target, a folder of its own beside it)."""
    fs, target = place_of(path)
    return fs, target, target.getParent().suffix(f"/.weft-{uuid.uuid4().hex}")


def _joined(lines: DataFrame, path: str, head: str = "") -> None:
    """A column ``value`` as a file, behind ``head``."""
    if path == "-":
        sys.stdout.write(head)
        for row in lines.toLocalIterator(prefetchPartitions=True):
            sys.stdout.write(row["value"] + "\n")
        sys.stdout.flush()
        return
    zipped = path.endswith(".gz")
    fs, target, folder = _hidden(path)
    jvm = lines.sparkSession._jvm
    try:
        lines.write.option("lineSep", "\n").text(folder.toString(), compression="gzip" if zipped else "none")
        parts = sorted((p.getPath() for p in fs.listStatus(folder) if p.getPath().getName().startswith("part-")), key=lambda p: p.getName())
        whole = folder.suffix("/whole")
        out = fs.create(whole, True)
        try:
            if head:
                out.write(bytearray(gzip.compress(head.encode(), mtime=0) if zipped else head.encode()))
            for part in parts:
                source = fs.open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
        finally:
            out.close()
        _put(fs, whole, target)
    finally:
        fs.delete(folder, True)


def _put(fs, made, target) -> None:
    fs.delete(target, True)
    if not fs.rename(made, target):
        raise OSError(f"{made.toString()} can't be renamed to {target.toString()}")


def write_text(frame: DataFrame, path: str, order: list[str], names: list[str] | None = None, escape: set[str] = frozenset()) -> None:
    """A table as tab-separated text with a header line, in ``order``. ``-`` is standard output; ``.gz`` is compressed."""
    rows = frame.orderBy(*order) if order else frame
    _joined(rows.select(F.concat_ws("\t", *cells(rows, escape)).alias("value")), path, "\t".join(names or frame.columns) + "\n")


def write_lines(frame: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A column ``line`` as it is, without a header."""
    _joined(frame.orderBy(*(order or ["line"])).select(c("line").alias("value")), path)


ROW_GROUP = 1_048_576


def write_comparison_parquet(frame: DataFrame, path: str) -> None:
    """The 93 typed columns, zstd, row groups of at most ROW_GROUP rows, with the version in the schema's metadata (which Spark keeps in the files' footers)."""
    marked = frame.withColumn("query_name", c("query_name").alias("query_name", metadata={schema.VERSION_KEY: schema.VERSION}))
    fs, target, folder = _hidden(path)
    try:
        marked.select(*frame.columns).write.option("compression", "zstd").option("parquet.block.row.count.limit", ROW_GROUP).parquet(folder.toString())
        _put(fs, folder, target)
    finally:
        fs.delete(folder, True)


def comparison_version(frame: DataFrame) -> str | None:
    return frame.schema["query_name"].metadata.get(schema.VERSION_KEY)


def write_summary(pairs: list[tuple[str, object]], path: str) -> None:
    """category and count; a few rows, so the driver writes them."""
    text = "category\tcount\n" + "".join(f"{k}\t{v}\n" for k, v in pairs)
    fs, target, folder = _hidden(path)
    try:
        out = fs.create(folder, True)
        out.write(bytearray(text.encode()))
        out.close()
        _put(fs, folder, target)
    finally:
        fs.delete(folder, True)


def show_summary(pairs: list[tuple[str, object]], title: str, only: set[str] | None = None) -> None:
    lines = [f"  {k:<34} {v}" for k, v in pairs if only is None or k in only]
    log.info("%s:\n%s", title, "\n".join(lines))


def remove(path: str) -> None:
    fs, target = place_of(path)
    fs.delete(target, True)


@contextmanager
def all_or_nothing(paths: list[str]):
    """If the block fails, none of ``paths`` stays."""
    try:
        yield
    except BaseException:
        for path in paths:
            if path and path != "-":
                remove(path)
        raise
