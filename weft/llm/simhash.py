"""SimHash near-duplicates: 64-bit fingerprints, blocks that close pairs share, components.

* Fingerprints: words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, shingles are
  ``shingle`` words joined by a space, repeats included; a text with fewer words is one shingle,
  one without words has the fingerprint zero. A bit is set if it is set in over half of the
  shingles' XXH64 (seed 42).
* Pigeonhole blocks: the 64 bits are split into ``distance + keep`` blocks. Two fingerprints
  that differ in at most ``distance`` bits agree on at least ``keep`` whole blocks, so they meet
  under at least one choice of ``keep`` blocks. Each such choice is a table; with the defaults
  there are 20 tables with keys of 31 to 33 bits, so a bucket holds few fingerprints even among
  billions of them.
* Only distinct fingerprints are joined: a group of copies, however large, is one row there.
* A bucket with more than ``HOT`` distinct fingerprints is split again: its members differ only
  in the other blocks, and close ones agree on at least one of ``distance + 1`` parts of those. A part's
  bucket that is still as large is split in the same way by the bits that are left, and so on, ``LEVELS`` times: of 33 bits 14 are left then, so no bucket holds more than 16,384 fingerprints.
* Components: big-star and small-star steps over links between distinct fingerprints, with a
  checkpoint after each round.

The pipeline's stage (``deduplicate``) has a setting of its own: texts are near duplicates if their sets of
shingles of ``SETS`` words have a Jaccard similarity of ``SIMILAR`` or more, or if their fingerprints are as
close as above. Pairs are met by MinHash: ``BANDS`` bands of ``ROWS`` least hashes, of which two texts share at
least one with probability 1 - (1 - J ** ROWS) ** BANDS, 0.9996 at 0.8. Pairs that are met are verified with
their whole sets, unless links join them already. Only distinct texts are met. Sets go to places where they meet
(``places``), not with pairs: a place is a family of texts that buckets chain together, or a bucket, and a large one is
cut into parts of which each two meet, so its tasks are bounded and no pair is left out.

Null texts count as empty; very long ones are hashed whole. Rows that share a doc_id each keep their own row. A
null doc_id is never a component's id unless its component has no other. Ids may be of any type that has an order.
An empty table gives an empty one. Extra columns are ignored by ``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import bounded, cut

HOT, LEVELS = 512, 3
SETS, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 5
#: Hashes of sets that a task compares at once, of each of two parts; a text weighs its hashes and LEAST.
PLACE, LEAST = 1 << 20, 512


def shingle_hashes(words: list[bytes], shingle: int) -> bytes:
    """The XXH64 digests of the shingles of a text with words."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends += 1
    np.cumsum(ends, out=ends)
    starts = [0, *ends[:-shingle].tolist()]
    return b"".join([digest(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())])


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of one UTF-8 text, as a signed 64-bit number."""
    words = text.lower().split()  # of bytes: only A-Z change, only ASCII white space splits
    return fingerprint_from(shingle_hashes(words, shingle)) if words else 0


def fingerprint_from(hashes: bytes) -> int:
    import numpy as np

    n = len(hashes) // 8
    grid = np.frombuffer(hashes, dtype=np.uint8).reshape(n, 8)
    if n < 64:
        ones = np.unpackbits(grid, axis=1).sum(axis=0, dtype=np.int64)
    else:
        counts = np.zeros((8, 256), dtype=np.int64)
        for k in range(8):
            counts[k] = np.bincount(grid[:, k], minlength=256)
        ones = (counts @ _BITS(np)).reshape(64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def _BITS(np, cache: list = []):  # noqa: B006, N802
    if not cache:
        cache.append(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64))
    return cache[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp bigint) for each row; ids keep their type."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([fingerprint_of(t.as_py(), shingle) for t in texts], pa.int64())], names=["doc_id", "fp"]
            )

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _blocks(distance: int, keep: int) -> list[int]:
    """Masks of the blocks, as unsigned numbers."""
    n = distance + keep
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_keys(fp: Column, distance: int = 3, keep: int = 3) -> Column:
    """array<struct<mask bigint, key bigint>>: the fingerprint under each choice of blocks."""
    keys = [_signed(sum(c)) for c in combinations(_blocks(distance, keep), keep)]
    return F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), fp.bitwiseAND(F.lit(m).cast("long")).alias("key")) for m in keys])


def _wider(mask: int, distance: int) -> list[int]:
    """``mask`` with each of ``distance + 1`` parts of the bits outside of it."""
    bits = [b for b in range(64) if not mask >> b & 1]
    n = distance + 1
    return [mask | sum(1 << b for b in bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def close_pairs(distinct: DataFrame, distance: int = 3, keep: int = 3) -> DataFrame:
    """(a, b): pairs a < b of the distinct fingerprints in column fp that differ in at most ``distance`` bits."""
    shared = distinct.select("fp", F.explode(block_keys(F.col("fp"), distance, keep)).alias("k")).select("k.mask", "k.key", "fp")
    masks, met = [sum(c) for c in combinations(_blocks(distance, keep), keep)], []
    for level in range(LEVELS + 1):
        buckets = cut(shared.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"))
        held = shared.join(buckets, ["mask", "key"])
        if level == LEVELS or buckets.filter(F.col("n") > HOT).isEmpty():
            met.append(held.select("mask", "key", "fp"))
            break
        met.append(held.filter(F.col("n") <= HOT).select("mask", "key", "fp"))
        # one row a mask, some twenty times (distance + 1) ** level
        rows = [(_signed(m), _signed(w)) for m in masks for w in _wider(m, distance)]
        wider = distinct.sparkSession.createDataFrame(rows, "mask bigint, wide bigint").distinct()
        split = held.filter(F.col("n") > HOT).join(F.broadcast(wider), "mask")
        shared = cut(split.select(F.col("wide").alias("mask"), F.col("fp").bitwiseAND(F.col("wide")).alias("key"), "fp").distinct())
        masks = sorted({w for m in masks for w in _wider(m, distance)})
    pairs = None
    for rows in met:
        a, b = rows.withColumnRenamed("fp", "a"), rows.withColumnRenamed("fp", "b")
        close = a.join(b, ["mask", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
        pairs = close if pairs is None else pairs.union(close)
    return pairs.distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that is reachable, for each node of links (a, b).

    Alternates big-star and small-star; the forest is a set of stars once a round changes nothing.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    for _ in range(rounds):
        # big-star: each node's larger neighbours get its smallest neighbour (or itself)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small-star: each node and its smaller neighbours get the smallest of them
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = cut(small.filter("u != v").distinct())
        sums = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        same = sums(after) == sums(edges)
        edges = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle; raise rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, keep: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, n_same, n_links.

    ``component_id`` is the smallest doc_id reachable, ``n_same`` counts the rows with this very
    fingerprint, ``n_links`` the other distinct fingerprints that it links to.
    """
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_same")))
    pairs = cut(close_pairs(classes.select("fp"), distance, keep))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = components(pairs).withColumnRenamed("node", "fp")
    rooted = cut(
        classes.join(roots, "fp", "left").join(degree, "fp", "left")
        .select("fp", "first_id", "n_same", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "fp").alias("root"))
    )
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = rooted.join(ids, "root").select("fp", "component_id", "n_same", "n_links")
    # A fingerprint may hold a third of the rows: the join of the narrow rows is left to adaptive
    # execution, which splits a skewed left side; known has one row a fingerprint.
    return fps.join(known, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same", "n_links"
    )


def shingle_set(words: list[bytes], hashes: bytes):
    """Sorted distinct hashes of the shingles of SETS = 5 words; ``hashes``: those of 3 words, of which two that overlap in a word make one of 5."""
    import numpy as np
    import xxhash

    if len(words) < SETS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], dtype=np.uint64)
    three = np.frombuffer(hashes, dtype=">u8").astype(np.uint64)
    mixed = (three[:-2] ^ three[:-2] >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + three[2:]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed * np.uint64(0xD6E8FEB86659FD93))


def bands_of(own):
    """BANDS hashes of ROWS least hashes each, as signed numbers; none of an empty set."""
    import numpy as np

    if not len(own):
        return []
    turns = np.random.default_rng(8).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 4096):
        mixed = (own[at : at + 4096, None] ^ turns[0]) * (turns[1] | np.uint64(1))
        mixed ^= mixed >> np.uint64(31)
        least = np.minimum(least, mixed.min(axis=0))
    total = np.arange(BANDS, dtype=np.uint64)  # a band's number is part of its hash
    for k in range(ROWS):
        total = (total ^ least[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total.view(np.int64).tolist()


def _text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, fp, weight, bands) for each row; th is the text's digest."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("th"), text.alias("text"))

    def run(batches):
        for batch in batches:
            fps, weights, bands = [], [], []
            for text in batch.column(2):
                words = text.as_py().lower().split()
                hashes = shingle_hashes(words, 3) if words else b""
                fps.append(fingerprint_from(hashes) if words else 0)
                own = shingle_set(words, hashes)
                weights.append(len(own) + LEAST)
                bands.append(bands_of(own))
            columns = [batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(weights, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "fp", "weight", "bands"])

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, th binary, fp bigint, weight bigint, bands array<bigint>")


def links_within(table: pa.Table, distance: int = 3) -> pa.Table:
    """(a, b): links that join what the SIMILAR texts of one place join; pairs that others join already are not compared.

    Texts are compared if they share a band; in a place with a key, if that is the first band that they share; in one of
    two parts, if they are of different parts. Pairs within ``distance`` bits are linked elsewhere.
    """
    import numpy as np

    flat = lambda name: table.column(name).combine_chunks()
    fps, part = flat("fp").to_numpy().view(np.uint64), flat("part").to_numpy()
    bands = flat("bands").flatten().to_numpy().reshape(len(fps), -1)
    key, two = table.column("key")[0].as_py(), table.column("x")[0] != table.column("y")[0]
    own = flat("own")
    edges = own.offsets.to_numpy() - own.offsets[0].as_py()
    starts, ends, sizes = edges[:-1], edges[1:], np.diff(edges).astype(np.int64)
    numbers = np.unique(own.flatten().to_numpy(), return_inverse=True)[1]
    mark, label = np.zeros(len(numbers), dtype=np.int64), np.unique(fps, return_inverse=True)[1]
    links = []
    for i in range(len(fps) - 1):
        same = bands[i + 1 :] == bands[i]
        meets = same.any(axis=1) & (label[i + 1 :] != label[i])
        if two:
            meets &= part[i + 1 :] != part[i]
        if key is not None:
            meets &= bands[i][same.argmax(axis=1)] == key
        at = np.flatnonzero(meets) + i + 1
        near = np.bitwise_count(fps[at] ^ fps[i]) <= distance
        for j in at[near]:
            label[label == label[j]] = label[i]
        at = at[label[at] != label[i]]
        if not len(at):
            continue
        mark[numbers[starts[i] : ends[i]]] = 1
        shared = mark[np.concatenate([numbers[starts[j] : ends[j]] for j in at])]
        both = np.add.reduceat(shared, np.cumsum(sizes[at]) - sizes[at])
        mark[numbers[starts[i] : ends[i]]] = 0
        for j in at[both >= SIMILAR * (sizes[i] + sizes[at] - both)]:
            if label[j] != label[i]:
                links.append((int(fps[i]), int(fps[j])))
                label[label == label[j]] = label[i]
    ends_of = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.table({"a": pa.array(ends_of[:, 0]), "b": pa.array(ends_of[:, 1])})


def places(shared: DataFrame) -> DataFrame:
    """(th, root, key, x, y, part): the places where a text of ``shared`` (key, th, fp, weight, low) is compared.

    A root is a family of texts that buckets chain together. A family is one place, of parts of some PLACE of weight each
    pair of which is a place (x, y) of its own; or, where that moves fewer sets, each of its buckets is, in the same way.
    """
    roots = components(shared.select(F.col("low").alias("a"), F.col("fp").alias("b"))).withColumnRenamed("node", "fp")
    rooted = cut(shared.join(roots, "fp", "left").select("key", "th", "weight", F.coalesce("root", "fp").alias("root")))
    parts = F.ceil(F.col("total") / PLACE).cast("int")
    texts = rooted.select("root", "th", "weight").distinct()
    families = texts.groupBy("root").agg(F.sum("weight").alias("total")).select("root", parts.alias("parts"), (F.col("total") * parts).alias("whole"))
    buckets = rooted.groupBy("root", "key").agg(F.sum("weight").alias("total")).select("root", "key", parts.alias("parts"), (F.col("total") * parts).alias("moved"))
    apart = cut(
        buckets.groupBy("root").agg(F.sum("moved").alias("moved")).join(families, "root").select("root", "parts", (F.col("moved") < F.col("whole")).alias("apart"))
    )
    by_family = texts.join(apart.filter("not apart"), "root").select("th", "root", F.lit(None).cast("bigint").alias("key"), "parts")
    by_bucket = rooted.join(apart.filter("apart").select("root"), "root").join(buckets.select("root", "key", "parts"), ["root", "key"]).select("th", "root", "key", "parts")
    part = F.pmod(F.xxhash64("th"), F.col("parts")).cast("int")
    tiled = by_family.union(by_bucket).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return tiled.select("th", "root", "key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part")


def similar_links(docs: DataFrame, rows: DataFrame, text_col: str = "text", distance: int = 3) -> DataFrame:
    """(a, b): links that, with those of ``distance`` bits, join all fingerprints of SIMILAR texts that share a band."""
    banded = rows.dropDuplicates(["th"]).select("th", "fp", "weight", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("key", "low")
    shared = cut(banded.join(buckets, "key"))
    wanted = bounded(cut(shared.select(F.col("th").alias("__th")).distinct()))
    held = cut(rows.join(wanted, F.col("th") == F.col("__th"), "left_semi").dropDuplicates(["th"]).select("th", "fp", "bands"))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    read = docs.select(F.unhex(F.md5(text)).alias("th"), text.alias("text")).join(wanted, F.col("th") == F.col("__th"), "left_semi")

    def run(batches):
        for batch in batches:
            sets = []
            for text in batch.column(1):
                words = text.as_py().lower().split()
                sets.append(shingle_set(words, shingle_hashes(words, 3)).view("int64"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["th", "own"])

    sets = read.mapInArrow(run, "th binary, own array<bigint>").dropDuplicates(["th"])
    met = cut(places(shared).join(held, "th")).join(sets, "th")
    return met.groupBy("root", "key", "x", "y").applyInArrow(lambda table: links_within(table, distance), "a bigint, b bigint")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the least id, a null id after all others.

    Rows are told apart by id and text, so rows that share an id, or have none, are judged each. If rows
    of a component share the least id, the one whose text's digest is least stays, and of these the one
    whose whole row has the least hash.
    """
    rows = cut(_text_rows(docs, id_col, text_col))
    links = close_pairs(rows.select("fp").distinct()).union(similar_links(docs, rows, text_col))
    roots = components(links).withColumnRenamed("node", "fp")
    keys = rows.groupBy("id", "th", "fp").agg(F.count("*").alias("n"))
    rooted = cut(keys.join(roots, "fp", "left").select("id", "th", "n", F.coalesce("root", "fp").alias("root")))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    first = rooted.groupBy("root").agg(F.min(place).alias("first"))
    judged = cut(rooted.join(first, "root").select("id", "th", "n", place.eqNullSafe(F.col("first")).alias("stays")))
    text = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))

    def on(ids: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        ids = bounded(cut(ids.select(F.col("id").alias("__id"), F.col("th").alias("__th"))))
        return rows.join(ids, F.col(id_col).eqNullSafe(F.col("__id")) & (text == F.col("__th")), how)

    kept = on(judged.filter("not stays"), "left_anti", docs)
    many = judged.filter("stays and n > 1")
    if many.isEmpty():
        return kept
    hashed = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in docs.columns]), 256)
    copies = on(many, "left_semi", docs).groupBy(F.col(id_col).alias("__id"), text.alias("__th")).agg(F.min_by(F.struct(*docs.columns), hashed).alias("__row"))
    return on(many, "left_anti", kept).union(copies.select("__row.*"))
