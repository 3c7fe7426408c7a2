"""Files by Hadoop paths: local, or on any file system that the session knows."""

from __future__ import annotations

import zlib

from pyspark.sql import SparkSession


def session() -> SparkSession:
    found = SparkSession.getActiveSession()
    return found or SparkSession.builder.getOrCreate()


def place_of(path: str):
    """(file system, qualified path); without a scheme, of the default file system."""
    spark = session()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(place)


def make_folder(path: str) -> str:
    fs, place = place_of(path)
    fs.mkdirs(place)
    return path.rstrip("/") or "/"


def head_of(path: str, n: int = 65536) -> bytes:
    """The first ``n`` bytes or somewhat more, decompressed if the file is gzip (of one or more members)."""
    fs, place = place_of(path)
    stream = fs.open(place)
    try:
        raw = bytes(stream.readNBytes(2))
        if raw != b"\x1f\x8b":
            return raw + bytes(stream.readNBytes(n))
        found, member, raw = b"", zlib.decompressobj(31), raw + bytes(stream.readNBytes(n))
        while raw and len(found) < n:
            found += member.decompress(raw, n)
            raw = member.unconsumed_tail
            if member.eof:
                raw, member = member.unused_data, zlib.decompressobj(31)
            if not raw and not member.eof:
                raw = bytes(stream.readNBytes(n))
        return found
    finally:
        stream.close()
