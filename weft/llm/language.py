"""Language ID by Bayesian evidence fusion.

Evidence on a document's language, added as log odds:

* text: likelihood of its byte trigrams (lower case, letters only) under a smoothed model of each
  language, over the whole text. Trigrams aren't independent, so the sum is tempered, and bounded.
* declared language: agrees with the truth with probability ``AGREES``.
* address suffix: a country's suffix of the host, if the host is an address; others say nothing.
* host prior: shares of languages among the host's documents, by their texts, smoothed towards those
  of its suffix, and these towards all documents'. Shares are sums over all rows, combined before
  the shuffle; a host with a third of all rows is one row a map task, and the join back salts it.

The models are fitted on at most ``train_rows`` labelled rows: of each declared language, those with the
least hashes of id and text, as many of each as the bound leaves, but three of each at least (if there are
so many), so every declared language of three rows has a model at any size. All else covers all rows. One more class, ``und``, takes any bytes equally, and is unlikely
beforehand; a text that it explains best, or one without letters, is of no known language and is rejected.

Null texts count as empty and are rejected. A null declared language or host is no evidence. Without
any labelled row nothing can be told, and every row is ``und`` but none rejected. Rows that repeat
are judged each. Languages with equal odds go by name. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import cut, skew_join, without_ids

TRAIN_ROWS = 4000
BUCKETS = 1 << 15
TEMPER, MOST = 0.25, 60.0
AGREES = 0.9
PULL = 20.0
UND_PRIOR = -6.0  # log odds of und before any text is seen; short texts with a name or a key in them stay
SUFFIXES = {"de": "de", "at": "de", "ch": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
UND = "und"


def letters_of(text: str) -> bytes:
    """Lower case; what isn't a letter (or beyond ASCII) separates words; one space between and around them."""
    words = text.lower().encode().translate(_LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b""


_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def trigrams_of(text: str):
    import numpy as np

    raw = np.frombuffer(letters_of(text), dtype=np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return raw[:0]
    mixed = raw[:-2] * np.uint32(0x9E3779B1)
    mixed ^= raw[1:-1] * np.uint32(0x85EBCA77)
    mixed += raw[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(17)


def fit(rows: list[tuple[str, str]]):
    """(languages, log likelihoods [BUCKETS, languages + und]) from (text, language); languages with under three rows are left out."""
    import numpy as np

    names = sorted(n for n in {lang for _, lang in rows} if sum(lang == n for _, lang in rows) >= 3)
    counts = np.full((BUCKETS, len(names)), 0.02)
    for text, lang in rows:
        if lang in names:
            counts[:, names.index(lang)] += np.bincount(trigrams_of(text), minlength=BUCKETS)
    table = np.log(counts / counts.sum(axis=0)) if names else counts
    return names, np.hstack([table, np.full((BUCKETS, 1), -np.log(BUCKETS))]).astype(np.float32)


def evidence(texts, table):
    """For each text: its letters' trigrams, and its tempered, bounded log odds against the best class."""
    import numpy as np

    for text in texts:
        grams = trigrams_of(text)
        total = np.zeros(table.shape[1])
        for at in range(0, len(grams), 65536):
            total += table[grams[at : at + 65536]].sum(axis=0, dtype=np.float64)
        yield len(grams), np.maximum((total - total.max()) * TEMPER, -MOST)


def _quota(counts: list[int], n: int) -> int:
    """The most rows a language so that all have at most ``n`` in all; 3 at least."""
    left, most = n, 0
    for k, count in enumerate(sorted(counts)):
        most = left // (len(counts) - k)
        if count > most:
            break
        left -= count
        most = count
    return max(3, most)


def _least_hashes(labelled: DataFrame, key: Column, n: int) -> list:
    """At most ``n`` rows (or 3 a language), those of each language with the least hashes.

    Rows over a bound that leaves somewhat more than a language's quota are dropped first, so tasks send few.
    """
    counts = {r["declared"]: r["count"] for r in labelled.groupBy("declared").count().collect()}  # one row a language
    if not counts:
        return []
    quota = _quota(list(counts.values()), n)
    bounds = [(lang, min(2**63 - 1, int((1.2 * quota + 300) / count * 2**63))) for lang, count in counts.items()]
    keyed = labelled.select(F.shiftrightunsigned(key, 1).alias("__key"), "text", "declared")
    few = keyed.join(F.broadcast(labelled.sparkSession.createDataFrame(bounds, "declared string, __bound bigint")), "declared").filter("__key <= __bound")
    order = Window.partitionBy("declared").orderBy("__key")
    rows = few.withColumn("__row", F.row_number().over(order)).filter(F.col("__row") <= quota).select("__key", "text", "declared").collect()
    found = Counter(r["declared"] for r in rows)
    for lang, count in counts.items():
        if found[lang] < min(3, count):  # nearly all of its rows are copies of one over the bound
            rows = [r for r in rows if r["declared"] != lang] + keyed.filter(F.col("declared") == lang).orderBy("__key").limit(3).collect()
    return sorted(rows, key=lambda r: (r["__key"], r["declared"]))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", train_rows: int = TRAIN_ROWS, train: DataFrame | None = None) -> DataFrame:
    """(doc_id, lang, posterior, text_lang, rejected), one row per row of ``docs``.

    ``train`` has columns text and lang; by default ``docs`` itself gives the labelled rows.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    null = F.lit(None).cast("string")
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        (F.col(declared_col).cast("string") if declared_col else null).alias("declared"),
        (F.col(host_col).cast("string") if host_col else null).alias("host"),
    )
    kind = own.schema["doc_id"].dataType.simpleString()
    labelled = train.select("text", F.col("lang").alias("declared")) if train is not None else own
    labelled = labelled.filter(F.col("declared").isNotNull())
    sample = _least_hashes(labelled, F.xxhash64("doc_id", "text") if train is None else F.xxhash64("text"), train_rows)
    names, table = fit([(r["text"], r["declared"]) for r in sample])
    if not names:
        return own.select("doc_id", F.lit(UND).alias("lang"), F.lit(0.0).alias("posterior"), F.lit(UND).alias("text_lang"), F.lit(False).alias("rejected"))
    n = len(names)

    def run(batches):
        for batch in batches:
            found = list(evidence((t.as_py() for t in batch.column(1)), table))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array([k for k, _ in found], pa.int64()), pa.array([v.tolist() for _, v in found], pa.list_(pa.float64()))],
                names=["doc_id", "declared", "host", "n_grams", "odds"],
            )

    texts = cut(own.mapInArrow(run, f"doc_id {kind}, declared string, host string, n_grams bigint, odds array<double>"))
    total = F.aggregate(F.slice("odds", 1, n), F.lit(0.0), lambda acc, x: acc + F.exp(x))
    suffix = F.when(F.col("host").contains("."), F.lower(F.element_at(F.split("host", "\\."), -1)))
    shares = texts.filter("n_grams > 0").select(suffix.alias("suffix"), "host", *[(F.exp(F.get("odds", F.lit(i))) / total).alias(f"p{i}") for i in range(n)])
    each = [f"p{i}" for i in range(n)]
    hosts = cut(shares.groupBy("suffix", "host").agg(*[F.sum(F.round(p, 6).cast("decimal(28,6)")).cast("double").alias(p) for p in each]))
    every = hosts.agg(*[F.coalesce(F.sum(p), F.lit(0.0)).alias(p) for p in each]).first()
    mass = sum(every[p] for p in each) or 1.0
    whole = [(every[p] + 1.0) / (mass + n) for p in each]
    ends = hosts.groupBy("suffix").agg(*[F.sum(p).alias(f"s{p}") for p in each]).withColumnRenamed("suffix", "__suffix")
    s_mass = sum((F.col(f"s{p}") for p in each[1:]), F.col("sp0"))
    ends = ends.select("__suffix", *[((F.col(f"s{p}") + PULL * whole[i]) / (s_mass + PULL)).alias(f"s{p}") for i, p in enumerate(each)])
    h_mass = sum((F.col(p) for p in each[1:]), F.col("p0"))
    named = hosts.join(ends, hosts["suffix"].eqNullSafe(ends["__suffix"])).filter(F.col("host").isNotNull())
    priors = cut(named.select("host", F.array(*[F.log((F.col(p) + PULL * F.col(f"s{p}")) / (h_mass + PULL)) for p in each]).alias("prior")))

    said = F.array(*[F.when(F.col("declared").isNull() | ~F.col("declared").isin(names), F.lit(0.0)).when(F.col("declared") == name, F.log(F.lit(AGREES))).otherwise(F.log(F.lit((1 - AGREES) / max(1, n - 1)))) for name in names])
    where = F.array(*[F.when(suffix.isin([s for s, lang in SUFFIXES.items() if lang == name]), F.log(F.lit(3.0))).otherwise(F.lit(0.0)) for name in names])
    even = F.array(*[F.lit(math.log(w)) for w in whole])
    met = skew_join(texts, priors, ["host"], "doc_id", how="left")
    prior = F.coalesce("prior", even)
    fused = F.transform(F.arrays_zip(F.slice("odds", 1, n).alias("t"), prior.alias("p"), said.alias("d"), where.alias("w")), lambda z: z["t"] + z["p"] + z["d"] + z["w"])
    ranked = met.select("doc_id", "n_grams", "odds", fused.alias("fused"))
    best = F.array_position("fused", F.array_max("fused"))
    text_best = F.array_position(F.slice("odds", 1, n), F.array_max(F.slice("odds", 1, n)))
    labels = F.array(*map(F.lit, names))
    ranked = ranked.select(
        "doc_id",
        ((F.col("n_grams") == 0) | (F.get("odds", F.lit(n)) + UND_PRIOR > F.array_max(F.slice("odds", 1, n)))).alias("rejected"),
        F.element_at(labels, best.cast("int")).alias("likely"),
        F.element_at(labels, text_best.cast("int")).alias("text_lang"),
        (F.lit(1.0) / F.aggregate(F.transform("fused", lambda x: F.exp(x - F.array_max("fused"))), F.lit(0.0), lambda acc, x: acc + x)).alias("posterior"),
    )
    return ranked.select("doc_id", F.when(F.col("rejected"), UND).otherwise(F.col("likely")).alias("lang"), F.round("posterior", 6).alias("posterior"), F.when(F.col("rejected"), UND).otherwise(F.col("text_lang")).alias("text_lang"), "rejected")


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """``docs`` without the rows that are rejected. Of rows that share an id, all go only if all are rejected."""
    found = identify(docs, id_col, text_col, declared_col, host_col)
    gone = cut(found.groupBy("doc_id").agg(F.min("rejected").alias("all")).filter("all").select("doc_id"))
    return without_ids(docs, gone, id_col)
