"""BAM files as SAM text lines, by a Python data source.

A BAM file is a row of gzip blocks (BGZF), which any gzip reader takes as one stream. Each file is read by
one task, record by record, so memory doesn't grow with the file; a set of many files is read by as many
tasks. What follows is repartitioned by read names anyway.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SEQ = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
INTS = {"c": ("<b", 1), "C": ("<B", 1), "s": ("<h", 2), "S": ("<H", 2), "i": ("<i", 4), "I": ("<I", 4)}


def header_of(file) -> tuple[str, list[str]]:
    """(SAM header text, contig names) at the start of a BAM stream."""
    if file.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    (n,) = struct.unpack("<i", file.read(4))
    text = file.read(n).split(b"\0")[0].decode()
    (count,) = struct.unpack("<i", file.read(4))
    names, made = [], []
    for _ in range(count):
        (size,) = struct.unpack("<i", file.read(4))
        name = file.read(size)[:-1].decode()
        (length,) = struct.unpack("<i", file.read(4))
        names.append(name)
        made.append(f"@SQ\tSN:{name}\tLN:{length}\n")
    return text if "@SQ" in text or not made else text + "".join(made), names


def tag_text(data: bytes) -> Iterator[str]:
    at = 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            yield f"{name}:A:{chr(data[at])}"
            at += 1
        elif kind in INTS:
            form, size = INTS[kind]
            yield f"{name}:i:{struct.unpack_from(form, data, at)[0]}"
            at += size
        elif kind == "f":
            yield f"{name}:f:{struct.unpack_from('<f', data, at)[0]:g}"
            at += 4
        elif kind in "ZH":
            end = data.index(0, at)
            yield f"{name}:{kind}:{data[at:end].decode()}"
            at = end + 1
        elif kind == "B":
            part = chr(data[at])
            (count,) = struct.unpack_from("<i", data, at + 1)
            form, size = INTS.get(part, ("<f", 4))
            values = [struct.unpack_from(form, data, at + 5 + k * size)[0] for k in range(count)]
            yield f"{name}:B:{part}" + "".join(f",{v:g}" if part == "f" else f",{v}" for v in values)
            at += 5 + count * size
        else:
            raise ValueError(f"tag {name} has the unknown type {kind}")


def record_text(data: bytes, names: list[str]) -> str:
    """A record's SAM line."""
    ref, pos, n_name, mapq, _, n_ops, flag, n_seq, next_ref, next_pos, length = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32
    name = data[at : at + n_name - 1].decode()
    at += n_name
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    packed = data[at : at + (n_seq + 1) // 2]
    at += (n_seq + 1) // 2
    quality = data[at : at + n_seq]
    at += n_seq
    tags = list(tag_text(data[at:]))
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops)
    long_cigar = next((t for t in tags if t.startswith("CG:B:I,")), None)
    if long_cigar and n_ops == 2 and ops[0] >> 4 == n_seq and ops[0] & 15 == 4:  # over 65,535 operations
        cigar = "".join(f"{int(x) >> 4}{OPS[int(x) & 15]}" for x in long_cigar[7:].split(","))
        tags.remove(long_cigar)
    seq = "".join(SEQ[b >> 4] + SEQ[b & 15] for b in packed)[:n_seq] or "*"
    qual = "*" if not n_seq or quality[0] == 255 else "".join(chr(q + 33) for q in quality)
    named = lambda i: names[i] if i >= 0 else "*"
    mate = "=" if next_ref == ref and ref >= 0 else named(next_ref)
    fields = [name or "*", flag, named(ref), pos + 1, mapq, cigar or "*", mate, next_pos + 1, length, seq, qual, *tags]
    return "\t".join(map(str, fields))


def lines_of(file) -> Iterator[str]:
    """Header and record lines of a decompressed BAM stream."""
    text, names = header_of(file)
    yield from text.splitlines()
    while len(size := file.read(4)) == 4:
        (n,) = struct.unpack("<i", size)
        data = file.read(n)
        if len(data) < n:
            raise ValueError("the BAM file ends within a record")
        yield record_text(data, names)


class BamFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class BamReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [BamFile(p) for p in self.paths]

    def read(self, partition):
        with gzip.open(partition.path, "rb") as file:
            for n, line in enumerate(lines_of(file)):
                yield (line, n)


class BamSource(DataSource):
    """``spark.read.format("weft_bam").load(path)``: (value, place). Paths are local to all executors; several are split by commas."""

    @classmethod
    def name(cls) -> str:
        return "weft_bam"

    def schema(self):
        return "value string, place bigint"

    def reader(self, schema):
        from glob import glob

        wanted = [p.removeprefix("file://") for p in self.options["path"].split(",")]
        return BamReader([q for p in wanted for q in (sorted(glob(p)) or [p])])


def read_bam_lines(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("weft_bam").load(path)
