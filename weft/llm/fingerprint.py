"""Document fingerprints by quartile bucket digests.

* Digest: a text's UTF-8 bytes are seen through windows of five. In each, six byte triplets are hashed
  to one of 256 buckets and counted. The quartiles of the bucket counts give each bucket two bits. A
  header holds the length on a log scale and the quartiles' ratios. 2 + 4 + 128 hex digits.
* Difference: the bounded sum, over buckets, of the distance of their two bits (a distance of 3 counts
  as 6), plus bounded differences of length and ratios. Likeness: 1 - difference / its bound; 1.0 only
  if the digests are equal. Texts without triplets have no body; they are like each other by length.
* The next document is found without one task that sees all ids: rows are split into ranges of (id, first
  ``PREFIX`` characters) of equal bytes, each range is a partition that is sorted by itself, and the first row of
  the next range is sent along as a sentinel. Ranges begin at keys of rows, drawn from the distinct keys by
  their hashes, so that row is known without another pass: it is the one whose key is the range's edge. The
  driver holds one edge a range of ``BYTES_A_RANGE``, and ``KEYS_A_RANGE`` keys a range (at most ``MOST_KEYS``) to
  choose from, as Spark's own range sort does.

Null texts count as empty. Rows are in order of (doc_id, text), null ids first; rows that share an id are next to
each other, and many of them are split by their texts. Rows that are equal in both are interchangeable; they share
a range, where each costs a comparison. The last row's next is the first. A single row is its own next. Very long
texts are hashed in pieces. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import cut

BUCKETS = 256
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: Odd multipliers and salts of the triplets' hashes.
MIX = ((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), (0x27D4EB2F, 0x165667B1, 0xD3A2646D), (0xFD7046C5, 0xB55A4F09, 0x8DA6B343), (0xD8163841, 0xCB1AB31F, 0x9F2E5B4D), (0xA3D95FA9, 0x7FEB352D, 0x846CA68B), (0x6C8E9CF5, 0xE7037ED1, 0xAB5351F7))
LENGTH_BOUND, RATIO_BOUND = 48, 24
BOUND = 6 * BUCKETS + LENGTH_BOUND + 2 * RATIO_BOUND
BYTES_A_RANGE = 128 << 20
KEYS_A_RANGE, MOST_KEYS = 60, 1_000_000
PREFIX = 32


def digest_of(data: bytes) -> str:
    """The digest of a UTF-8 text."""
    import numpy as np

    counts = np.zeros(BUCKETS, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    step = 1 << 18  # a long text is counted in pieces, which overlap by a window less one
    for at in range(0, max(len(raw) - 4, 0), step):
        piece = raw[at : at + step + 4].astype(np.uint32)
        n = len(piece) - 4
        cols = [piece[k : k + n] for k in range(5)]
        for (i, j, k), (a, b, c) in zip(TRIPLETS, MIX):
            mixed = cols[i] * np.uint32(a)
            mixed ^= cols[j] * np.uint32(b)
            mixed += cols[k] * np.uint32(c)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(mixed >> np.uint32(24), minlength=BUCKETS)
    size = min(255, round(16 * math.log2(len(data) + 1) / 2)) if len(data) else 0
    if not counts.any():
        return f"{size:02x}"
    low, mid, high = (int(x) for x in np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    first, second = (round(255 * low / high), round(255 * mid / high)) if high else (255, 255)
    codes = (counts > low).astype(np.uint8) + (counts > mid) + (counts > high)
    quads = codes.reshape(-1, 4)
    body = (quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]).astype(np.uint8)
    return f"{size:02x}{first:02x}{second:02x}{body.tobytes().hex()}"


def difference(one: str, other: str) -> int:
    """0 to BOUND."""
    import numpy as np

    if one == other:
        return 0
    apart = min(LENGTH_BOUND, abs(int(one[:2], 16) - int(other[:2], 16)))
    if len(one) == 2 or len(other) == 2:
        return apart + (0 if len(one) == len(other) else 6 * BUCKETS + 2 * RATIO_BOUND)
    for at in (2, 4):
        apart += min(RATIO_BOUND, abs(int(one[at : at + 2], 16) - int(other[at : at + 2], 16)))
    a, b = (np.frombuffer(bytes.fromhex(x[6:]), dtype=np.uint8) for x in (one, other))
    for shift in (0, 2, 4, 6):
        steps = np.abs((a >> shift & 3).astype(np.int64) - (b >> shift & 3))
        apart += int(steps.sum() + 3 * (steps == 3).sum())
    return apart


def likeness(one: str, other: str) -> float:
    return 1.0 - difference(one, other) / BOUND


def edited(text: str, after: str) -> str:
    """The last half of the text's code points gives way to as many of the next text's first (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


SCHEMA = "doc_id {id}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches):
    """Rows of a partition in order of (part, doc_id, text), sentinels last in their part."""
    import hashlib

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held, kind = None, None
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        out = []
        parts, sentinels, ids, texts = (batch.column(c).to_pylist() for c in ("part", "sentinel", "doc_id", "text"))
        for part, sentinel, doc, text in zip(parts, sentinels, ids, texts):
            if held is None and sentinel:
                continue
            own = held[3] if held is not None and held[2] == text else digest_of(text.encode())
            if held is not None and held[0] == part:
                _, was, before, digest = held
                raw = edited(before, text).encode()
                changed = digest_of(raw)
                out.append((was, len(before), hashlib.sha256(raw).hexdigest(), digest, changed, likeness(digest, changed), likeness(digest, own)))
            held = None if sentinel else (part, doc, text, own)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 7, (kind, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()))], names=names)


def _edges(own: DataFrame, n_parts: int) -> list[tuple]:
    """The least keys of at most ``n_parts`` ranges of about equal bytes: (id is known, id, prefix). The first is the least key of all."""
    keys = cut(own.groupBy("doc_id", "prefix").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "prefix")
    all_keys = keys.agg(F.count("*").alias("n"), F.min(key).alias("least")).first()
    fraction = min(1.0, min(KEYS_A_RANGE * n_parts, MOST_KEYS) / all_keys["n"])
    some = keys.filter(F.pmod(F.xxhash64("doc_id", "prefix"), F.lit(1 << 30)) < F.lit(math.ceil(fraction * (1 << 30)))).select("doc_id", "prefix", "bytes", "n").collect()
    drawn = sorted((r["doc_id"] is not None, r["doc_id"], r["prefix"], r["bytes"], r["n"]) for r in some) if n_parts > 1 else []
    share, seen = (sum(r[3] for r in drawn) or 1) / n_parts, 0
    edges = [tuple(all_keys["least"])]
    for k, (known, doc, prefix, size, n) in enumerate(drawn):
        # a key of several rows would send all of them along
        if seen >= share and n == 1 and (known, doc, prefix) != edges[0]:
            edges.append((known, doc, prefix))
            seen = 0
        seen += size
    return edges


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likenesses; see the module's head."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.substring(text, 1, PREFIX).alias("prefix"), (F.octet_length(text) + 1).cast("long").alias("bytes"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    size = narrow.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    if not size["n"]:
        return docs.sparkSession.createDataFrame([], SCHEMA.format(id=kind))
    wanted = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size["bytes"] / BYTES_A_RANGE))
    edges = _edges(narrow, min(wanted, size["n"]))
    n_parts = len(edges)

    @F.arrow_udf(returnType="struct<part:int,also:int>")
    def place(ids: pa.Array, prefixes: pa.Array) -> pa.Array:
        from bisect import bisect_right

        parts, also = [], []
        for doc, prefix in zip(ids.to_pylist(), prefixes.to_pylist()):
            key = (doc is not None, doc, prefix)
            part = bisect_right(edges, key) - 1
            parts.append(part)
            also.append((part - 1) % n_parts if edges[part] == key else None)
        return pa.StructArray.from_arrays([pa.array(parts, pa.int32()), pa.array(also, pa.int32())], ["part", "also"])

    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    placed = own.withColumn("place", place("doc_id", F.substring("text", 1, PREFIX)))
    one = lambda part, sentinel: F.struct(F.col(part).alias("part"), F.lit(sentinel).alias("sentinel"))
    sent = placed.select("doc_id", "text", F.explode(F.when(F.col("place.also").isNull(), F.array(one("place.part", False))).otherwise(F.array(one("place.part", False), one("place.also", True)))).alias("at"))
    ordered = sent.select("at.part", "at.sentinel", "doc_id", "text").repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "sentinel", "doc_id", "text")
    return ordered.mapInArrow(_rows, SCHEMA.format(id=kind))


def edited_texts(docs: DataFrame) -> DataFrame:
    """The part of ``fingerprint_pairs`` that SQL can express."""
    return fingerprint_pairs(docs).select("doc_id", "n_chars", "edited_sha256")


EDITED_ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER o, first_value(t) OVER o) AS after FROM d WINDOW o AS (ORDER BY doc_id NULLS FIRST, t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(after, length(t) // 2)) AS edited_sha256 FROM n
"""
